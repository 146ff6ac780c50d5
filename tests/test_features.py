"""The stateful stream against a plain count, over several batches."""

import random
from collections import defaultdict
from datetime import datetime, timezone

from logloom.functions.hosts import host_zones
from logloom.streaming import features

SCHEMA = "event_id bigint, timestamp string, hostname string, category string, severity string, repeats int, received_at timestamp"


def tables(spark):
    inventory = spark.createDataFrame([("a", "s", "UTC"), ("b", "s", "UTC")], "hostname string, site_id string, tz_name string")
    return host_zones(inventory, spark.createDataFrame([("s", "UTC")], "site_id string, tz_name string"))


def mixture(spark):
    return spark.createDataFrame([], "source string, key string, best string, posterior double")


def some(n, seed=3):
    rng, rows = random.Random(seed), []
    for i in range(n):
        stamp = rng.choice(["", None, "bad", "2025-10-10T00:00:%02dZ" % rng.randint(0, 59), "2025/10/10 01:02:%02d" % rng.randint(0, 59)])
        rows.append((i, stamp, rng.choice(["a", "A.x", " b", "", None, "c"]), rng.choice(["x", " X", None, "y"]), rng.choice(["high", "HIGH ", "low"]), rng.choice([None, 1, 5]), datetime(2025, 10, 11, tzinfo=timezone.utc)))
    return rows + rows[:: 7]


def plain(rows):
    seen, out = set(), defaultdict(lambda: [0, 0, -1])
    for i, stamp, h, c, s, k, _ in rows:
        h = (h or "").strip().lower().split(".")[0]
        if i in seen or not h:
            continue
        seen.add(i)
        cell = out[h, (c or "other").strip().lower(), s.strip().lower()]
        at = -1
        if stamp and stamp.endswith("Z"):
            at = int(datetime.fromisoformat(stamp).timestamp()) * 1_000_000
        elif stamp and "/" in stamp and h in "ab":
            at = int(datetime.strptime(stamp + "+0000", "%Y/%m/%d %H:%M:%S%z").timestamp()) * 1_000_000
        cell[0], cell[1], cell[2] = cell[0] + 1, cell[1] + (k or 1), max(cell[2], at)
    return {k: tuple(v) for k, v in out.items()}


def asdict(df):
    return {(r["hostname"], r["category"], r["severity"]): (r["n_events"], r["total_repeats"], r["last_us"]) for r in df.collect()}


def test_stream_equals_plain_count_and_goes_on(spark, tmp_path, monkeypatch):
    """Rows of hosts stay whole from batch to batch, over compactions and a stream that is taken up again."""
    monkeypatch.setattr(features, "COMPACT", 3)
    rows = some(400)
    source, target, state = str(tmp_path / "in.parquet"), str(tmp_path / "out"), str(tmp_path / "state")
    spark.createDataFrame(rows[:200], SCHEMA).repartition(3).write.parquet(source)
    features.maintain(spark, source, tables(spark), mixture(spark), target, state, files_per_batch=1)
    spark.createDataFrame(rows[200:], SCHEMA).repartition(2).write.mode("append").parquet(source)
    features.maintain(spark, source, tables(spark), mixture(spark), target, state, files_per_batch=1)
    assert features._numbers(spark, target) == [3, 4]
    table = features.read(spark, target)
    assert asdict(features.cells_of(table)) == plain(rows)
    wide = {r["hostname"]: r for r in table.collect()}
    own = {k: v for k, v in plain(rows).items() if k[0] == "a"}
    assert wide["a"]["n_events"] == sum(v[0] for v in own.values()) and [(f["category"], f["severity"]) for f in wide["a"]["features"]] == sorted(k[1:] for k in own)


def test_upsert_again_changes_nothing(spark, tmp_path):
    cell = "hostname string, category string, severity string, n_events bigint, total_repeats bigint, last_us bigint"
    target = str(tmp_path / "t")
    features.upsert(spark.createDataFrame([("a", "x", "low", 1, 1, -1), ("a", "y", "low", 2, 2, 5), ("b", "x", "low", 1, 1, 1)], cell), 0, target)
    for _ in range(2):
        features.upsert(spark.createDataFrame([("a", "x", "low", 3, 4, 9), ("c", "x", "low", 1, 1, 1)], cell), 1, target)
    got = {r["hostname"]: r for r in features.read(spark, target).collect()}
    assert (got["a"]["n_events"], got["a"]["total_repeats"], got["a"]["last_us"], len(got["a"]["features"])) == (5, 6, 9, 2) and sorted(got) == ["a", "b", "c"]
    features.upsert(spark.createDataFrame([], cell), 2, target)
    assert features.read(spark, target).count() == 3 and features.read(spark, str(tmp_path / "none")).collect() == []


def test_batch_form_and_empty(spark):
    rows = some(50, 5)
    assert asdict(features.cells(spark.createDataFrame(rows, SCHEMA), tables(spark), mixture(spark))) == plain(rows)
    assert features.cells(spark.createDataFrame([], SCHEMA + ", n_events int"), tables(spark), mixture(spark)).collect() == []
