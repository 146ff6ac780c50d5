"""Mixtures: the flow, the drawing and the report."""

import pytest

from logloom.llm import mixing

SIZES = "doc_id bigint, source string, digest string, tokens bigint"
TARGETS = "source string, target_share double, max_repeats int"


def mix(spark, docs, targets, **kw):
    t = spark.createDataFrame(targets, TARGETS)
    chosen = mixing.select(spark.createDataFrame(docs, SIZES), t, **kw)
    rows = chosen.collect()
    return rows, {r["source"]: r for r in mixing.report(chosen, t).collect()}


def test_shares_and_repeats(spark):
    docs = [(i, "big", f"b{i}", 10) for i in range(3000)] + [(10_000 + i, "small", f"s{i}", 10) for i in range(200)]
    rows, got = mix(spark, docs, [(" Big", 0.5, 1), ("small", 0.5, 3), ("none", 0.1, 2)])
    assert abs(got["small"]["share"] - 0.5) < 0.01 and got["none"]["tokens"] == 0
    assert got["small"]["most_uses"] <= 3 and got["big"]["most_uses"] == 1
    assert got["small"]["tokens"] >= 5900
    assert len({(r["doc_id"], r["source"]) for r in rows}) == len(rows)


def test_repetition_starts_where_it_must(spark):
    docs = [(i, "a", f"a{i}", 7) for i in range(100)]
    rows, _ = mix(spark, docs, [("a", 1.0, 4)], total=1050)
    assert sorted({r["uses"] for r in rows}) == [1, 2] and abs(sum(r["uses"] * r["tokens"] for r in rows) - 1050) <= 14
    assert len(rows) >= 99


def test_copies_in_several_sources_are_routed(spark):
    """Texts that stand in both sources fill the one that has nothing else."""
    docs = [(i, "a", f"x{i}", 10) for i in range(100)] + [(1000 + i, "b", f"x{i}", 10) for i in range(50)]
    rows, got = mix(spark, docs, [("a", 0.5, 1), ("b", 0.5, 1)])
    assert abs(got["b"]["share"] - 0.5) < 0.03 and got["b"]["tokens"] >= 480
    assert len({r["doc_id"] for r in rows}) == len(rows) and max(r["doc_id"] for r in rows) < 1000


def test_seed_decides_and_repeats(spark):
    docs = [(i, "a", f"a{i}", 5) for i in range(400)]
    one = mix(spark, docs, [("a", 1.0, 1)], total=500, seed=1)[0]
    assert sorted(map(tuple, one)) == sorted(map(tuple, mix(spark, docs, [("a", 1.0, 1)], total=500, seed=1)[0]))
    assert {r["doc_id"] for r in one} != {r["doc_id"] for r in mix(spark, docs, [("a", 1.0, 1)], total=500, seed=2)[0]}


def test_flow_is_cheapest():
    flow = mixing.Flow(4)
    cheap, dear = flow.add(0, 1, 5, 0), flow.add(0, 2, 5, 3)
    flow.add(1, 3, 9, 0), flow.add(2, 3, 9, 0)
    assert flow.run(0, 3) == 10 and flow.edges[cheap][1] == flow.edges[dear][1] == 0
    given = mixing.route({("a",): 10, ("a", "b"): 10}, {"a": (0.5, 1), "b": (0.5, 1)})
    assert given[("a",), "a"] == 10 and given[("a", "b"), "b"] == 10


@pytest.mark.parametrize("docs", [[], [(1, "", "x", 5)], [(1, "a", "x", 0)], [(1, "zz", "x", 5)]])
def test_nothing_to_choose(spark, docs):
    rows, got = mix(spark, docs, [("a", 1.0, 2)])
    assert rows == [] and got["a"]["n_documents"] == 0


def test_token_counts(spark):
    import os

    if not os.path.exists(mixing.TOKENIZER):
        pytest.skip("no tokenizer here")
    df = spark.createDataFrame([(1, "hello world", " A "), (2, None, None), (3, "", "b"), (4, "<|endoftext|>", "b")], "doc_id bigint, text string, source string")
    got = {r["doc_id"]: (r["source"], r["tokens"]) for r in mixing.token_counts(df).collect()}
    assert got[1] == ("a", 2) and got[2] == ("", 0) and got[3] == ("b", 0) and got[4][1] > 1
