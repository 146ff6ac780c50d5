"""Session helpers: reading tables, the shared checkpoint folder, sized joins."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes, written out as JSON, up to which a stored dimension is hinted for broadcast; above them the join shuffles.
BROADCAST_BYTES = 32 << 20
_made: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="logloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder below the application's own in the shared one, which is deleted when the driver's process ends."""
    own = f"{shared_dir(spark)}/logloom/{spark.sparkContext.applicationId}"
    if own not in _made:
        _made.add(own)
        atexit.register(_delete, spark._jvm, spark._jsc.hadoopConfiguration(), own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _delete(jvm, conf, path: str) -> None:
    try:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # noqa: BLE001, S110 - the virtual machine is gone: the folder's owner has to clean up
        pass


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def stored(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df to the shared folder and read it back."""
    path = work_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def sized(dim: DataFrame, label: str = "dimension", most: int = BROADCAST_BYTES) -> DataFrame:
    """dim, stored, and hinted for broadcast only if its rows take `most` bytes at most, written out."""
    own = dim if hasattr(dim, "_stored_at") else stored(dim, label)
    if size_of(own.sparkSession, own._stored_at) > most:
        return own
    width = F.coalesce(F.octet_length(F.to_json(F.struct("*"))), F.lit(0)).cast("bigint")
    return F.broadcast(own) if (own.agg(F.sum(width)).first()[0] or 0) <= most else own


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are evaluated once, however often later steps name them.

    They come out of a generator, which projections and filters above it aren't merged with."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def ranked(df: DataFrame, order: list, out: str) -> DataFrame:
    """df with out: 1, 2, ... in the order of all rows, sorted in ranges by many tasks; ties get any order.

    The ranges are written once; their sizes, a row each, give the rank at which each begins."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    own = F.monotonically_increasing_id()
    at = stored(sorted_.withColumns({"_range": F.shiftright(own, 33), "_place": own.bitwiseAND((1 << 33) - 1)}), "ranked")
    sizes = at.groupBy("_range").agg(F.count("*").alias("_n"))
    starts = sizes.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_start"))
    return at.join(F.broadcast(starts), "_range").withColumn(out, F.col("_start") + F.col("_place") + 1).drop("_range", "_place", "_start")


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes of a file or folder."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return int(p.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(p).getLength())


@contextmanager
def settings(spark: SparkSession, **wanted: str):
    """Session settings, with __ for the dots, that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in wanted.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def state_partitions(spark: SparkSession, path: str, per: int = 32 << 20) -> str:
    """Partitions of a stream's state: one for each `per` bytes of its first input, 8 at least, no more than a shuffle has by default.

    They stay as they are for the life of a checkpoint."""
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return str(min(max(8, size_of(spark, path) // per), max(8, most)))


def local_session(app: str = "logloom", cores: str | None = None) -> SparkSession:
    """A session for tests and the bench; cluster settings come from spark-submit."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
