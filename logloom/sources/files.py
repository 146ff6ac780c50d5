"""Log files, site bundles and configured sources."""

from __future__ import annotations

import os
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: How a terminal program names its recordings - host (address) -- date.
RECORDING = r"^([A-Za-z0-9][\w.\-]*)\s*\("


def host_of_file(path: Column) -> Column:
    """The host a file's name stands for: that of a recording, else the name without its last ending."""
    name = F.regexp_replace(F.regexp_replace(path, "%20", " "), r"^.*/", "")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    found = F.regexp_extract(stem, RECORDING, 1)
    return F.when(found != "", found).otherwise(stem)


def listing(spark: SparkSession, path: str, pattern: str = "*.log", recursive: bool = True) -> DataFrame:
    """path, length of the files below a folder that fit the pattern; ValueError where there's no such folder. Contents aren't read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p) or not fs.getFileStatus(p).isDirectory():
        raise ValueError(f"not a folder: {path}")
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).load(path)
    return found.select("path", "length")


def count_files(spark: SparkSession, path: str, pattern: str = "*.log", recursive: bool = True) -> int:
    return listing(spark, path, pattern, recursive).count()


def text_lines(spark: SparkSession, text: str, default_host: str = "") -> DataFrame:
    """stream, seq, line, default_host of a text at hand."""
    one = spark.createDataFrame([(text,)], "text string")
    return one.select(F.lit("").alias("stream"), F.posexplode(F.split("text", r"\r?\n")).alias("seq", "line")).select("stream", F.col("seq").cast("bigint").alias("seq"), "line", F.lit(default_host).alias("default_host"))


def read_lines(spark: SparkSession, path: str, pattern: str = "*.log", recursive: bool = True, default_host: str = "", max_files: int = 0) -> DataFrame:
    """stream, seq, line, default_host of the text files at path, with max_files of the first so many by path.

    A file is a stream. seq is the line's number in a split of its file, above the start of the split, so it grows along a
    file as long as files are read in order; compressed files are one split."""
    paths: str | list[str] = path
    if max_files:
        paths = [r["path"] for r in listing(spark, path, pattern, recursive).orderBy("path").limit(max_files).collect()]
        if not paths:
            return spark.createDataFrame([], "stream string, seq bigint, line string, default_host string")
    df = spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", str(recursive).lower()).text(paths)
    at = df.select(F.col("_metadata.file_path").alias("stream"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    own = F.lit(default_host) if default_host else host_of_file(F.col("stream"))
    return at.select("stream", (F.col("start") * 1024 + F.col("n") % (1 << 33)).alias("seq"), "line", own.alias("default_host"))


def site_bundle(spark: SparkSession, root: str) -> DataFrame:
    """site_id, hostname, platform, function, config_text of the bundles below root: manifest.json and one text per device.

    Devices whose file is missing drop out; a missing platform is the first word of the vendor."""
    manifests = spark.read.option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "manifest.json").json(root)
    dirs = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "")
    devices = manifests.select("site", "vendor", dirs.alias("dir"), F.explode("devices").alias("d"))
    field = lambda n: F.coalesce(F.col(f"d.{n}"), F.lit("")) if n in devices.schema["d"].dataType.names else F.lit("")
    devices = devices.select(F.col("site").alias("site_id"), F.concat("dir", F.lit("/"), F.col("d.file")).alias("path"), F.col("d.hostname").alias("hostname"), F.when(field("platform") != "", field("platform")).otherwise(F.lower(F.substring_index(F.coalesce("vendor", F.lit("")), " ", 1))).alias("platform"), field("function").alias("function"))
    texts = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root, wholetext=True)
    texts = texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("config_text"))
    return devices.join(texts, "path").drop("path")


class Sources:
    """Configured sources by id; a later one of the same id replaces the earlier."""

    SECRET = ("token", "password", "cookie")

    def __init__(self) -> None:
        self._known: dict[str, dict[str, str]] = {}

    def add(self, source_id: str, kind: str, **options: str) -> None:
        self._known[source_id] = {"kind": kind, **options}

    def remove(self, source_id: str) -> bool:
        return self._known.pop(source_id, None) is not None

    def describe(self) -> list[dict[str, str]]:
        """Ids and options, without what signs in."""
        return [{"id": i, **{k: v for k, v in o.items() if k not in self.SECRET}} for i, o in sorted(self._known.items())]

    def health(self) -> dict[str, tuple[bool, str]]:
        """Of each source, whether its service answers."""
        from logloom.sources import rest

        return {i: rest.health(o["kind"], o) if o["kind"] in rest.KINDS else (True, "not asked") for i, o in sorted(self._known.items())}

    def close(self) -> None:
        """Forget all sources and what signs in to them."""
        self._known.clear()

    def read(self, spark: SparkSession, source_id: str, **more: str) -> DataFrame:
        options = {**self._known[source_id], **more}
        return spark.read.format(f"log_{options.pop('kind')}").options(**options).load()

    def from_environment(self, prefix: str = "LOGLOOM_SOURCE_", env: Mapping[str, str] = os.environ) -> int:
        """Add a source for each id of variables <prefix><id>_<field> that has TYPE and URL; how many."""
        groups: dict[str, dict[str, str]] = {}
        for name, value in env.items():
            if name.startswith(prefix) and "_" in (rest := name[len(prefix) :]):
                source_id, field = rest.split("_", 1)
                groups.setdefault(source_id.lower(), {})[field.lower()] = value
        added = {i: g for i, g in groups.items() if g.get("type") and g.get("url")}
        for i, g in added.items():
            self.add(i, g.pop("type"), **g)
        return len(added)
