"""Shared passages against a plain search."""

import random
import re
import time

import numpy as np

from logloom.llm import leaks

DOCS, ITEMS = "doc_id bigint, text string", "item_id bigint, item_text string"


def plain(docs, items, least):
    words = lambda t: re.findall("[a-z0-9]+", "".join(c if ord(c) < 128 else " " for c in t or "").lower())
    out = {}
    for d, t in docs:
        w = words(t)
        for i, s in items:
            v, best = words(s), 0
            for a in range(len(w)):
                for b in range(len(v)):
                    n = 0
                    while a + n < len(w) and b + n < len(v) and w[a + n] == v[b + n]:
                        n += 1
                    best = max(best, n)
            if best >= least:
                out[d, i] = best
    return out


def got(spark, docs, items, **kw):
    found = leaks.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS), **kw)
    rows = found.collect()
    assert len({(r["doc_id"], r["item_id"]) for r in rows}) == len(rows)
    return {(r["doc_id"], r["item_id"]): r["n_words"] for r in rows}


def test_equals_plain_search(spark):
    rng = random.Random(2)
    vocabulary = ["the", "lower", "trunk", "Group", "17", "hides", "é", "slow"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(3, 30)))) for i in range(12)]
    docs = []
    for d in range(25):
        parts = []
        for _ in range(3):
            s = rng.choice(items)[1].split()
            a = rng.randint(0, len(s))
            parts += [", ".join(s[a : a + rng.randint(1, 20)]), rng.choice(["other", "the", "x-y\n"])]
        docs.append((d, " ".join(parts)))
    want = plain(docs, items, 6)
    assert want and got(spark, docs, items, least=6) == want
    assert got(spark, docs, items, least=6, shard_words=40, block_words=60) == want


def test_suffix_order():
    """All words up to the next 0 decide, not only the first ones; equal suffixes stand by position."""
    assert leaks.suffix_array(np.array([1, 2, 3, 9, 0, 1, 2, 3, 5, 0, 1, 2, 3, 7, 0]), 3).tolist() == [5, 10, 0, 6, 11, 1]
    rng = random.Random(4)
    for n in (0, 1, 5, 40, 700):
        for width in (2, 4, 300):
            text = [rng.randrange(width) for _ in range(n)]
            end = lambda p: next((i for i in range(p, n) if text[i] == 0), n)  # noqa: E731, B023
            want = sorted((p for p in range(n) if end(p) - p >= 2), key=lambda p: (text[p : end(p)], p))
            assert leaks.suffix_array(np.array(text, dtype=np.int64), 2).tolist() == want


def test_a_passage_with_many_copies():
    item = np.arange(1, 101)
    text = np.tile(np.append(item[20:80], 0), 100_000)
    began = time.time()
    found = leaks.matches(text[:1_220_000], np.arange(0, 1_220_000, 61), [item, item[30:60]], 12)
    assert len(found) == 40_000 and set(found["n_words"]) == {60, 30} and set(found["doc_word"]) == {0, 10} and time.time() - began < 60


def test_places(spark):
    item = " ".join(f"w{i}" for i in range(20))
    docs = [(1, "x y " + " ".join(item.split()[3:17]) + " z " + " ".join(item.split()[5:19]) + " z " + " ".join(item.split()[:12]))]
    row = leaks.find(spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item)], ITEMS)).collect()[0]
    assert (row["n_words"], row["doc_word"], row["item_word"]) == (14, 2, 3)


def test_twelve_words_and_borders(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = [(1, "x " + item.upper().replace(" ", ";\r\n") + " y"), (2, " ".join(item.split()[:11])), (3, " ".join(item.split()[:7])), (4, " ".join(item.split()[7:])), (5, None), (6, ""), (7, " ".join(item.split()[1:])), (7, " ".join(item.split()[1:]))]
    assert got(spark, docs, [(1, item), (2, None), (3, "short")]) == {(1, 1): 13, (7, 1): 12}


def test_empty_and_long(spark):
    item = " ".join(f"w{i}" for i in range(14))
    assert got(spark, [], [(1, item)]) == {} and got(spark, [(1, item)], []) == {}
    assert got(spark, [(1, "z " * 300_000 + item)], [(1, item)]) == {(1, 1): 14}


def test_cleaned(spark):
    item = " ".join(f"w{i}" for i in range(14))
    docs = spark.createDataFrame([(1, item), (2, "fine"), (3, None)], DOCS)
    found = leaks.find(docs, spark.createDataFrame([(1, item)], ITEMS))
    assert sorted(r["doc_id"] for r in leaks.cleaned(docs, found).collect()) == [2, 3]
