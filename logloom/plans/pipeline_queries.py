"""The p1, p2 and p3 queries over the tables of a data directory."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.session import table
from logloom.operators import lines, timestamps
from logloom.plans import instant_sql
from logloom.streaming import features

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.entries(lines.sources(table(spark, sf_dir, "raw_line"), table(spark, sf_dir, "log_event")))
    return found.select("src_table", "first_seq", "last_seq", "severity_raw", "appname")


def p1_log_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LogEvent rows with the whole text of every entry."""
    found = lines.entries(lines.sources(table(spark, sf_dir, "raw_line"), table(spark, sf_dir, "log_event")))
    return found.select("src_table", "stream", "first_seq", "last_seq", "severity_raw", "appname", "text")


def p1_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LogEvent rows as they go on to classification: stamp, severity, program and whole message of every entry."""
    found = lines.entries(lines.sources(table(spark, sf_dir, "raw_line"), table(spark, sf_dir, "log_event")))
    return found.drop("text")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.cells_of(features.feature_table(spark, sf_dir))


def p2_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per host; its cells as text, category/severity=events:repeats:latest instant."""
    told = F.transform("features", lambda f: F.concat(f["category"], F.lit("/"), f["severity"], F.lit("="), F.concat_ws(":", *[f[c].cast("string") for c in ("n_events", "total_repeats", "last_us")])))
    return features.feature_table(spark, sf_dir).withColumn("features", F.array_join(told, ","))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    inventory, sites = table(spark, sf_dir, "device_inventory"), table(spark, sf_dir, "site_manifest")
    parts = []
    for name, row_id in (("log_event", "seq"), ("classified_event", "event_id")):
        at = timestamps.table_instants(table(spark, sf_dir, name), row_id, inventory, sites)
        parts.append(at.where("utc_us is not null and not plain").select(F.lit(name).alias("src_table"), "row_id", "utc_us"))
    return parts[0].unionByName(parts[1])


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (p1_found, p1_log_events, p1_messages, p2_found, p2_feature_rows, p3_found)}


def oracle_sql() -> dict[str, str]:
    return instant_sql.entry_queries() | instant_sql.queries()
