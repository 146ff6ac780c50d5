"""Feature rows per host, kept up to date by a stateful stream.

The stream drops event ids that it has seen, reads each stamp as an instant and keeps, for every host and pair of category
and severity, the number of events, the sum of repeats and the latest instant in the checkpointed state. After each batch
the full rows of the hosts that changed are upserted: the changed cells replace those of the host's row, and the row goes
whole into the batch's version of the table. The newest version of a host's row counts. Every COMPACT batches a version
holds all hosts, and those before it go once it is followed by another. A batch that runs again after a failure reads the
versions before it and overwrites its own, so nothing counts twice.

Counting starts before the shuffle: a host that holds a third of all events sends one row per task and cell. A row is as
long as a host has pairs of category and severity. The state holds a counter per cell and, as an event may be sent again at
any time, every id seen (some 50 bytes each on disk, spread by hash); it lives in RocksDB, not in memory. `mixture` may come
from an earlier table: a source it doesn't know has its bare digits read in the unit with the shortest delay."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logloom.functions.hosts import host_zones, norm_word
from logloom.functions.session import drop, exists, settings, sized, state_partitions, table, work_dir
from logloom.operators.timestamps import fit_mixture, normalize, stamp_rows

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def cells(events: DataFrame, zones: DataFrame, mixture: DataFrame) -> DataFrame:
    """hostname, category, severity, n_events, total_repeats, last_us of events, a table or a stream.

    A null category is `other`, a null severity the text ''; null repeats count as 1; an event_id counts once (a null id is
    one id); events without host are left out; last_us is -1 where no event of the cell has an instant. No events, no rows;
    further columns are ignored."""
    category = F.coalesce(F.when(norm_word("category") != "", norm_word("category")), F.lit("other"))
    once = events.select("event_id", "timestamp", "hostname", category.alias("category"), F.coalesce(norm_word("severity"), F.lit("")).alias("severity"), F.coalesce("repeats", F.lit(1)).cast("bigint").alias("repeats"), "received_at").dropDuplicates(["event_id"])
    row = F.struct(F.col("event_id").alias("id"), "category", "severity", "repeats")
    rows = stamp_rows(once.withColumn("row", row), "row")
    at = normalize(rows, zones, mixture).where("source is not null")
    return at.groupBy(F.col("source").alias("hostname"), F.col("row_id.category").alias("category"), F.col("row_id.severity").alias("severity")).agg(
        F.count("*").alias("n_events"), F.sum("row_id.repeats").alias("total_repeats"), F.coalesce(F.max("utc_us"), F.lit(-1).cast("bigint")).alias("last_us")
    )


ROW = "hostname string, n_events bigint, total_repeats bigint, last_us bigint, features array<struct<category:string,severity:string,n_events:bigint,total_repeats:bigint,last_us:bigint>>"
CELL = ("category", "severity", "n_events", "total_repeats", "last_us")
#: Batches between versions of the table that hold all hosts.
COMPACT = 16


def feature_rows(cells: DataFrame) -> DataFrame:
    """One row per host: totals and its cells, by category and severity."""
    return cells.groupBy("hostname").agg(
        F.sum("n_events").alias("n_events"), F.sum("total_repeats").alias("total_repeats"), F.max("last_us").alias("last_us"), F.array_sort(F.collect_list(F.struct(*CELL))).alias("features")
    )


def cells_of(rows: DataFrame) -> DataFrame:
    """The cells of feature_rows()."""
    return rows.select("hostname", F.inline("features"))


def latest(versions: DataFrame) -> DataFrame:
    """The newest version of each host's row."""
    columns = [c for c in versions.columns if c not in ("hostname", "version")]
    return versions.groupBy("hostname").agg(F.max_by(F.struct(*columns), "version").alias("v")).select("hostname", "v.*")


def _numbers(spark: SparkSession, target: str) -> list[int]:
    """Versions of the table, oldest first."""
    if not exists(spark, target):
        return []
    p = spark._jvm.org.apache.hadoop.fs.Path(target)
    names = [f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)]
    return sorted(int(n.removeprefix("version=")) for n in names if n.startswith("version="))


def read(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """hostname and the feature row of every host, of the versions below `before`; no rows where there is no table yet.

    Nothing older than the last version that holds all hosts is read."""
    known = [n for n in _numbers(spark, target) if before is None or n < before]
    whole = max((n for n in known if n % COMPACT == 0), default=0)
    paths = [f"{target}/version={n}" for n in known if n >= whole]
    if not paths:
        return spark.createDataFrame([], ROW)
    return latest(spark.read.schema(ROW + ", version int").option("basePath", target).parquet(*paths))


def upsert(batch: DataFrame, batch_id: int, target: str) -> None:
    """Write the full rows of the hosts of a batch of changed cells as version batch_id of the table at target."""
    spark = batch.sparkSession
    changed, before = batch.select("hostname", *CELL), read(spark, target, batch_id)
    if batch_id % COMPACT:
        before = before.join(changed.select("hostname").distinct(), "hostname", "left_semi")
    both = changed.withColumn("new", F.lit(1)).unionByName(cells_of(before).withColumn("new", F.lit(0)))
    # Partitioned by host once: cells and rows are grouped where they are.
    newest = both.repartition("hostname").groupBy("hostname", "category", "severity").agg(F.max_by(F.struct(*CELL[2:]), "new").alias("v")).select("hostname", "category", "severity", "v.*")
    feature_rows(newest).write.mode("overwrite").parquet(f"{target}/version={batch_id}")
    if batch_id % COMPACT == 1:
        # The version before this one holds all hosts, and a batch that runs again reads nothing older.
        for n in _numbers(spark, target):
            if n < batch_id - 1:
                drop(spark, f"{target}/version={n}")


def maintain(spark: SparkSession, path: str, zones: DataFrame, mixture: DataFrame, target: str, checkpoint: str, files_per_batch: int = 32) -> None:
    """Bring the table at target up to date with the files at path; what checkpoint knows isn't read again."""
    schema = spark.read.parquet(path).schema
    # As a glob: the source takes a folder of files and a single file alike.
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path[:-1]}[{path[-1]}]")
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKS, spark__sql__streaming__stateStore__rocksdb__changelogCheckpointing__enabled="true", spark__sql__shuffle__partitions=state_partitions(spark, path)):
        out = cells(stream, zones, mixture).writeStream.outputMode("update").foreachBatch(lambda batch, n: upsert(batch, n, target))
        query = out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def feature_table(spark: SparkSession, sf_dir: str, files_per_batch: int = 32) -> DataFrame:
    """The feature rows of classified_event, by way of the stream."""
    events = table(spark, sf_dir, "classified_event")
    zones = sized(host_zones(table(spark, sf_dir, "device_inventory"), table(spark, sf_dir, "site_manifest")), "zones")
    mixture = sized(fit_mixture(stamp_rows(events, "event_id")), "mixture")
    target, checkpoint = work_dir(spark, "features"), work_dir(spark, "features-state")
    maintain(spark, f"{sf_dir}/classified_event.parquet", zones, mixture, target, checkpoint, files_per_batch)
    return read(spark, target)
