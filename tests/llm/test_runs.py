"""Runs against a plain walk over each host's events."""

import random
from collections import Counter

from logloom.llm import runs

SCHEMA = "host string, us bigint, id bigint, kind string"


def plain(rows, gap):
    out, last = [], {}
    events = sorted({(h, u, i, k or "") for h, u, i, k in rows if h is not None and u is not None}, key=lambda e: (e[0], e[1], e[2]))
    for h, u, i, k in events:
        r = last.get(h)
        if r and r[1] == k and u - r[4] <= gap:
            r[4], r[5], r[6] = u, i, r[6] + 1
        else:
            last[h] = [h, k, u, i, u, i, 1]
            out.append(last[h])
    return sorted(map(tuple, out))


def got(df, **kw):
    return sorted((r["host"], r["kinds"][0], r["first_us"], r["first_id"], r["last_us"], r["last_id"], r["n"]) for r in runs.runs(df, **kw).collect())


def test_equal_kinds_over_many_ranges(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["a"] * 6 + ["b", "c", None]), rng.choice([None] + [rng.randint(0, 9000)] * 20), i, rng.choice("xxxxy") if rng.random() > 0.02 else None) for i in range(3000)]
    rows += rows[::9]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 5, 16):
        assert got(df, gap_us=20, partitions=n) == plain(rows, 20)


def test_one_long_run_over_all_ranges(spark):
    rows = [("a", i, i, "x") for i in range(5000)]
    assert got(spark.createDataFrame(rows, SCHEMA), gap_us=1, partitions=8) == [("a", "x", 0, 0, 4999, 4999, 5000)]


def test_little_is_held(spark, monkeypatch):
    """A host that never pauses is folded piece by piece; runs go on from piece to piece."""
    monkeypatch.setattr(runs, "HELD", 7)
    rng = random.Random(6)
    rows = [("a" if i < 1500 else "b", i, i, "x" if rng.random() < 0.9 else "y") for i in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    for n in (1, 4):
        assert got(df, gap_us=5, partitions=n) == plain(rows, 5)


def test_agglomeration_takes_the_most_similar_first():
    def run(i, **kinds):
        return ["h", dict(kinds), i, i, i, i, sum(kinds.values())]

    out = runs.agglomerate([run(0, a=1, b=1), run(1, a=3, b=1), run(2, a=3, b=1), run(3, c=1)], 0.7, 10)
    assert [r[6] for r in out] == [10, 1] and out[0][1] == {"a": 7, "b": 3}
    assert len(runs.agglomerate([run(0, a=1, b=1), run(1, a=1)], 0.7, 10)) == 2
    assert len(runs.agglomerate([run(0, a=1), run(100, a=1)], 0.7, 10)) == 2
    assert runs.similarity(Counter(a=1, b=1), Counter(a=2, b=2)) == 1.0


def test_near_identical_kinds(spark):
    """With a lower limit a slowly changing series folds; the counts stay whole."""
    rows = [("a", i, i, "x" if i % 10 else "y") for i in range(200)]
    found = runs.runs(spark.createDataFrame(rows, SCHEMA), least=0.8, gap_us=5, partitions=1).collect()
    assert sum(r["n"] for r in found) == 200
    assert sum(c for r in found for c in r["counts"]) == 200


def test_empty_and_extra_columns(spark):
    assert runs.runs(spark.createDataFrame([], SCHEMA)).collect() == []
    df = spark.createDataFrame([("a", 1, 1, "x", "y")], SCHEMA + ", n string")
    assert [r["n"] for r in runs.runs(df).collect()] == [1]
