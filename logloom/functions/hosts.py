"""Host names and the zones that hosts keep their clocks in."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as blank around a value.
BLANKS = " \t\r\n\f\v\ufeff"


def host(col: Column | str) -> Column:
    """The short name: no surrounding blanks, lower case, cut at the first dot; null for none."""
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(F.substring_index(F.lower(F.btrim(c, F.lit(BLANKS))), ".", 1), F.lit(""))


def norm_word(col: Column | str) -> Column:
    """Without surrounding blanks, in lower case."""
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(F.btrim(c, F.lit(BLANKS)))


def _abbreviations(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    for batch in batches:
        rows = []
        for name in batch["zone"]:
            try:
                zone = ZoneInfo(name)
            except Exception:  # noqa: BLE001 - an unknown zone names no clock
                continue
            at, end, seen = datetime(1970, 1, 1, tzinfo=timezone.utc), datetime(2038, 1, 1, tzinfo=timezone.utc), {}
            while at < end:
                there = at.astimezone(zone)
                abbr, off = there.tzname(), int(there.utcoffset().total_seconds())
                if abbr and abbr[0].isalpha() and off not in seen.setdefault(abbr, []):
                    seen[abbr].append(off)
                at += timedelta(days=20)
            rows.append((name, seen))
        yield pd.DataFrame(rows, columns=["zone", "abbr"])


def zone_table(zones: DataFrame) -> DataFrame:
    """(zone, abbr MAP<STRING, ARRAY<BIGINT>>) of every known zone in zones.zone; unknown names drop out.

    There are some 600 zones, so the result is bounded whatever the input."""
    names = zones.select("zone").where(F.col("zone").isNotNull()).distinct()
    return names.mapInPandas(_abbreviations, "zone string, abbr map<string, array<bigint>>")


def host_zones(inventory: DataFrame, sites: DataFrame) -> DataFrame:
    """(host, zone, abbr): the device's own zone, else that of its site; hosts without a known zone drop out.

    A host listed more than once keeps its least (site, zone)."""
    at = sites.select(F.col("site_id").alias("s"), F.col("tz_name").alias("site_zone")).groupBy("s").agg(F.min("site_zone").alias("site_zone"))
    own = inventory.select(host("hostname").alias("host"), F.col("site_id").alias("s"), F.col("tz_name").alias("own_zone")).where("host is not null")
    per = own.join(at, "s", "left").select("host", F.coalesce("own_zone", "site_zone").alias("zone")).groupBy("host").agg(F.min("zone").alias("zone"))
    return per.join(F.broadcast(zone_table(per)), "zone").select("host", "zone", "abbr")
