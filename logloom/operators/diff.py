"""Differences between captures of a configuration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions import config_rules as R
from logloom.functions.hosts import host


def pairs(profiles: DataFrame) -> DataFrame:
    """host, before_id, after_id, before, after of each capture and the one before it of the same host.

    Neighbours are found by id; only then are the texts joined."""
    own = profiles.select(host("hostname").alias("host"), "captured_at", "profile_id").where("host is not null").distinct()
    over = Window.partitionBy("host").orderBy("captured_at", "profile_id")
    ids = own.withColumn("before_id", F.lag("profile_id").over(over)).where("before_id is not null").select("host", "before_id", F.col("profile_id").alias("after_id"))
    text = profiles.select("profile_id", F.regexp_replace(F.coalesce("config_text", F.lit("")), "\r", "").alias("text")).dropDuplicates(["profile_id"])
    before, after = text.select(F.col("profile_id").alias("before_id"), F.col("text").alias("before")), text.select(F.col("profile_id").alias("after_id"), F.col("text").alias("after"))
    return ids.join(before, "before_id").join(after, "after_id").select("host", "before_id", "after_id", "before", "after")


def section(line: Column) -> Column:
    out = None
    for name, p in R.SECTIONS:
        hit = F.lower(line).rlike(p)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("other")


def sections(captures: DataFrame) -> DataFrame:
    """host, after_id, section, added, removed: lines that one capture has more of than the other, as a multiset."""
    lines = lambda c, n: captures.select("host", "after_id", F.explode(F.split(c, "\n")).alias("line"), F.lit(n).alias("n"))
    both = lines("after", 1).unionByName(lines("before", -1)).groupBy("host", "after_id", "line").agg(F.sum("n").alias("n")).where("n != 0")
    n = F.col("n")
    return both.groupBy("host", "after_id", section(F.col("line")).alias("section")).agg(F.sum(F.greatest(n, F.lit(0))).alias("added"), F.sum(F.greatest(-n, F.lit(0))).alias("removed"))


def _unified(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import difflib

    for batch in batches:
        text = ["\n".join(difflib.unified_diff(b.split("\n"), a.split("\n"), "before", "after", lineterm="")) for b, a in zip(batch["before"], batch["after"], strict=True)]
        yield batch[["host", "before_id", "after_id"]].assign(diff=text)


def unified(captures: DataFrame) -> DataFrame:
    """host, before_id, after_id, diff: the usual unified text, '' for equal captures."""
    return captures.mapInPandas(_unified, "host string, before_id bigint, after_id bigint, diff string")
