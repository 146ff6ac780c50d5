"""Log events as streams: running counts, windows, sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from logloom.functions.session import settings, state_partitions, work_dir
from logloom.operators import events

LATE = "10 minutes"


def read(spark: SparkSession, path: str, files_per_batch: int = 32) -> DataFrame:
    """A stream of the Parquet files at path, a folder or a single file."""
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")


def run_now(counts: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Run an aggregating stream over what is at path; the newest version of each key, from a table in the shared folder."""
    spark = counts.sparkSession
    target = work_dir(spark, "stream")

    def upsert(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/version={batch_id}")

    with settings(spark, spark__sql__shuffle__partitions=state_partitions(spark, path)):
        query = counts.writeStream.outputMode("update").foreachBatch(upsert).option("checkpointLocation", work_dir(spark, "stream-state")).trigger(availableNow=True).start()
    query.awaitTermination()
    values = [c for c in counts.columns if c not in keys]
    rows = spark.read.schema(StructType([*counts.schema.fields, StructField("version", IntegerType())])).option("basePath", target).parquet(f"{target}/version=*")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "version").alias("v")).select(*keys, "v.*")


def severity_counts(stream: DataFrame) -> DataFrame:
    return events.classify(stream).groupBy("severity", "category").agg(F.count("*").alias("n"))


def timed(stream: DataFrame) -> DataFrame:
    """Classified events with event_time, the arrival, under a watermark."""
    own = stream.withWatermark("received_at", LATE)
    text = lambda c: F.coalesce(c, F.lit(""))
    key = F.lower(F.concat(text("appname"), F.lit(" "), events.strip_escapes(text("message"))))
    rule = events.first_rule(key, [r[0] for r in events.rules.CLASSIFICATION])
    category = F.coalesce(F.try_element_at(F.array(*[F.lit(r[2]) for r in events.rules.CLASSIFICATION]), rule + 1), F.lit("other"))
    return own.select(F.col("received_at").alias("event_time"), events.short_host(F.col("hostname")).alias("hostname"), category.alias("category"))


def windows(stream: DataFrame, length: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """start, hostname, category, n in tumbling or sliding windows of arrival."""
    w = F.window("event_time", length, slide or length)
    return timed(stream).groupBy(w.alias("w"), "hostname", "category").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "hostname", "category", "n")


def sessions(stream: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """start, end, hostname, n of stretches of a host's events without a longer pause."""
    return timed(stream).groupBy(F.session_window("event_time", gap).alias("w"), "hostname").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "hostname", "n")


def alerts(counted: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Windows with more events of a category than its limit."""
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return counted.where(F.col("n") > F.try_element_at(limit, F.col("category")))
