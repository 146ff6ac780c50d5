"""Printed timestamps of many formats and zones as one UTC instant per row.

Most stamps have one valid parse. Bare digits may be seconds, milliseconds, microseconds or nanoseconds, and slash dates
may have either order where the caller doesn't say. For these an expectation-maximisation runs per source: every valid
parse of a value has the likelihood of its delay (arrival less instant, in buckets) under the source's mixture of formats;
the posteriors choose the parse, and a value whose best posterior stays below `sure` is marked `ambiguous`.

The mixture is fitted on counts of (source, parses with their delay buckets), aggregated before the shuffle, so a source
that holds a third of all rows contributes a few dozen rows to it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logloom.functions import hosts, stamps
from logloom.functions.session import sized

#: Microseconds a unit of an epoch stamp has, by format name; nanoseconds divide.
UNITS = ("epoch_s", "epoch_ms", "epoch_us", "epoch_ns")
#: Upper ends, in seconds, of the delay buckets 1 to 6; bucket 0 is an instant after arrival, 7 the rest.
DELAYS = (60, 3600, 86_400, 604_800, 31_536_000, 315_360_000)
#: Seconds that each bucket spans; a likelihood is a density, its bucket's weight by its width.
WIDTHS = (10**9, 60, 3540, 82_800, 518_400, 30_931_200, 283_824_000, 10**9)
ROUNDS = 20


def _bucket(delay_us: Column) -> Column:
    out = F.when(delay_us < 0, 0)
    for i, s in enumerate(DELAYS, 1):
        out = out.when(delay_us <= s * 1_000_000, i)
    return out.otherwise(len(DELAYS) + 1)


def _epoch_us(digits: Column, fraction: Column, unit: str) -> Column:
    """Microseconds of digits read in a unit; null where they leave the range of a timestamp."""
    n = digits.try_cast("bigint")
    part = lambda k: F.when(fraction == "", 0).otherwise(F.rpad(fraction, k, "0").try_cast("bigint"))
    whole = {
        "epoch_s": F.when(n < 100_000_000_000, n * 1_000_000 + part(6)),
        "epoch_ms": F.when(n < 100_000_000_000_000, n * 1000 + part(3)),
        "epoch_us": F.when(n < 100_000_000_000_000_000, n),
        "epoch_ns": F.call_function("div", n, F.lit(1000)),  # whole numbers: a double has too few digits
    }
    return whole[unit]


def parses(df: DataFrame, zones: DataFrame | None, slash_order: str = "mdy") -> DataFrame:
    """df(row_id, stamp, hostname, seen) with source, plain BOOLEAN, fmt, us and, where a value
    may have several parses, cands ARRAY<STRUCT<fmt, us, late>>.

    zones is host_zones(); None leaves stamps without zone unread."""
    t = F.btrim(F.col("stamp"), F.lit(hosts.BLANKS))
    base = df.select("row_id", "stamp", "seen", F.unix_micros("seen").alias("seen_us"), hosts.host("hostname").alias("source"), t.alias("t"))
    if zones is None:
        base = base.withColumns({"zone": F.lit(None).cast("string"), "abbr": F.lit(None).cast("map<string,array<bigint>>")})
    else:
        base = base.join(zones.withColumnRenamed("host", "source"), "source", "left")
    base = base.withColumn("parts", stamps.split_parts(F.col("t")))
    base = stamps.with_instant(base, "at")
    lay = F.col("parts")[0]
    cand = lambda fmt, us: F.struct(fmt.alias("fmt"), us.alias("us"), _bucket(F.col("seen_us") - us).alias("late"))

    def epochs(x: Column) -> Column:
        digits, frac = F.substring_index(x, ".", 1), F.substring_index(x, ".", -1)
        return F.filter(F.array(*[cand(F.lit(u), _epoch_us(digits, frac, u)) for u in UNITS]), lambda c: c["us"].isNotNull())

    several = F.when(lay == "epoch", stamps.rare(F.col("parts")[4], epochs))
    if slash_order == "em":
        base = base.withColumn("swapped", F.when(lay == "mdy", F.array(*[F.col("parts")[i] for i in (0, 1, 3, 2, 4, 5, 6)])))
        base = stamps.with_instant(base, "at2", "swapped")
        both = F.array(cand(F.lit("mdy"), F.col("at")), cand(F.lit("dmy_slash"), F.col("at2")))
        several = several.when(lay == "mdy", F.filter(both, lambda c: c["us"].isNotNull()))
    row = F.struct("row_id", "source", "seen_us", F.coalesce(F.col("stamp").rlike(stamps.PLAIN_UTC), F.lit(False)).alias("plain"), lay.alias("fmt"), F.col("at").alias("us"), several.alias("cands"))
    # A generator keeps later filters above it: pushed below, each would repeat the parsing.
    return base.select(F.inline_outer(F.array(row)))


def _key(cands: Column) -> Column:
    return F.concat_ws(",", F.transform(cands, lambda c: F.concat(c["fmt"], F.lit(":"), c["late"].cast("string"))))


def _mixture(group: pd.DataFrame) -> pd.DataFrame:
    """EM over one source: weights of formats and of delay buckets, from counted values with several parses."""
    values = [[(f, int(b)) for f, b in (x.split(":") for x in k.split(","))] for k in group["key"]]
    n = group["n"].to_numpy(dtype="float64")
    formats, width = sorted({f for v in values for f, _ in v}), len(DELAYS) + 2
    weight = dict.fromkeys(formats, 1 / len(formats))
    late = [0.02 if b == 0 else 2.0**-b for b in range(width)]
    prior = late[:]
    posts: list[list[float]] = []
    for _ in range(ROUNDS):
        posts = []
        for v in values:
            p = [weight[f] * late[b] / WIDTHS[b] for f, b in v]
            total = sum(p) or 1.0
            posts.append([x / total for x in p])
        w, d = dict.fromkeys(formats, 0.5), [x * 2 for x in prior]
        for v, p, k in zip(values, posts, n, strict=True):
            for (f, b), x in zip(v, p, strict=True):
                w[f] += k * x
                d[b] += k * x
        sw, sd = sum(w.values()), sum(d)
        weight, late = {f: x / sw for f, x in w.items()}, [x / sd for x in d]
    rows = []
    for k, v, p in zip(group["key"], values, posts, strict=True):
        best = max(range(len(v)), key=lambda i: (p[i], -i))
        rows.append((k, v[best][0], p[best]))
    out = pd.DataFrame(rows, columns=["key", "best", "posterior"])
    out.insert(0, "source", group["source"].iloc[0])
    return out


def _mixtures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_mixture() of every source; rows come sorted by source, and a source may go on in the next batch."""
    rest = None
    for batch in batches:
        rows = batch if rest is None else pd.concat([rest, batch])
        last = rows["source"].iloc[-1] if len(rows) else None
        done, rest = rows[rows["source"] != last], rows[rows["source"] == last]
        if len(done):
            yield pd.concat([_mixture(own) for _, own in done.groupby("source", sort=False)])
    if rest is not None and len(rest):
        yield _mixture(rest)


def fit_mixture(df: DataFrame, zones: DataFrame | None = None, slash_order: str = "mdy") -> DataFrame:
    """(source, key, best, posterior): for each source and combination of valid parses, the parse that the mixture chooses.

    Only stamps with more than one valid parse are counted. Rows without host form the source ''."""
    unclear = F.btrim(F.col("stamp"), F.lit(hosts.BLANKS)).rlike(stamps.EPOCH if slash_order != "em" else rf"{stamps.EPOCH}|^\d+/\d+/\d{{4}}")
    found = parses(df.where(unclear), zones if slash_order == "em" else None, slash_order).where(F.size("cands") > 1)
    counts = found.groupBy(F.coalesce("source", F.lit("")).alias("source"), _key(F.col("cands")).alias("key")).agg(F.count("*").alias("n"))
    # Sources follow each other within a partition: one call a batch of sources, not one each.
    return counts.repartition("source").sortWithinPartitions("source").mapInPandas(_mixtures, "source string, key string, best string, posterior double")


def normalize(df: DataFrame, zones: DataFrame, mixture: DataFrame, slash_order: str = "mdy", sure: float = 0.9) -> DataFrame:
    """One row per row of df(row_id, stamp, hostname, seen): row_id, source, plain, utc_us, fmt, posterior, status.

    status is `ok`, `ambiguous` (utc_us holds the likelier reading) or `none` (utc_us is null: null, empty, impossible or
    useless stamps, and stamps without zone of rows without a known host). Repeated rows give repeated rows; further
    columns are ignored. Works on streams too, where zones and mixture are static."""
    found = parses(df, zones, slash_order).withColumn("key", F.when(F.size("cands") > 1, _key(F.col("cands"))))
    m = mixture.select(F.col("source").alias("m_source"), F.col("key").alias("m_key"), "best", "posterior")
    # Rows with one parse have a null key: they match nothing and needn't be near the mixture's rows.
    joined = found.join(m, (F.coalesce(found["source"], F.lit("")) == m["m_source"]) & (found["key"] == m["m_key"]), "left")
    likeliest = F.coalesce(F.col("best"), F.array_min(F.transform("cands", lambda c: F.struct(c["late"], c["fmt"])))["fmt"])
    chosen = F.when(F.col("cands").isNotNull(), stamps.rare(likeliest, lambda f: F.try_element_at(F.filter("cands", lambda c: c["fmt"] == f), F.lit(1)))).otherwise(F.struct("fmt", "us", F.lit(0).alias("late")))
    out = joined.select("row_id", "source", "plain", chosen.alias("c"), F.when(F.col("key").isNotNull(), F.coalesce("posterior", F.lit(0.0))).otherwise(1.0).alias("posterior"))
    status = F.when(F.col("c.us").isNull(), "none").when(F.col("posterior") >= sure, "ok").otherwise("ambiguous")
    return out.select("row_id", "source", "plain", F.col("c.us").alias("utc_us"), F.when(F.col("c.us").isNotNull(), F.col("c.fmt")).alias("fmt"), "posterior", status.alias("status"))


def stamp_rows(df: DataFrame, row_id: str, *keep: str) -> DataFrame:
    """The four columns that this module reads, of a table with timestamp, hostname and received_at."""
    return df.select(F.col(row_id).alias("row_id"), F.col("timestamp").alias("stamp"), "hostname", F.col("received_at").alias("seen"), *keep)


def table_instants(df: DataFrame, row_id: str, inventory: DataFrame, sites: DataFrame) -> DataFrame:
    """normalize() over a whole table with the zones of its hosts."""
    rows = stamp_rows(df, row_id)
    return normalize(rows, sized(hosts.host_zones(inventory, sites), "zones"), sized(fit_mixture(rows), "mixture"))
