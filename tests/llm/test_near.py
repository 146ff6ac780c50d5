"""The similarity join against all pairs."""

import random
from collections import Counter
from itertools import combinations

from logloom.llm import near

SCHEMA = "kind string, key bigint, text string"


def some(rng, families=12, words=60):
    rows, key = [], 0
    vocabulary = [f"w{i}" for i in range(400)] + ["at"] * 30
    for _ in range(families):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(words - 15, words + 30))]
        for _ in range(rng.randint(1, 9)):
            text = base[:]
            for _ in range(rng.randint(0, 12)):
                at = rng.randrange(len(text))
                how = rng.random()
                if how < 0.4:
                    text[at] = rng.choice(vocabulary)
                elif how < 0.7:
                    del text[at]
                else:
                    text.insert(at, rng.choice(vocabulary))
            rng.random() < 0.3 and rng.shuffle(text)
            rows.append((rng.choice(["log_event", "log_event", "action_item"]), key, " ".join(text).upper() if rng.random() < 0.1 else ", ".join(text)))
            key += 1
    return rows + [(k, i + 100_000, t) for k, i, t in rows[::4]]


def plain(rows, threshold, least):
    sets = [(k, i, Counter(t.lower().replace(",", " ").split())) for k, i, t in rows if t]
    out = set()
    for (ka, a, x), (kb, b, y) in combinations([s for s in sets if sum(s[2].values()) >= least], 2):
        common = sum((x & y).values())
        if ka == kb and a != b and common >= threshold * (sum(x.values()) + sum(y.values()) - common) - 1e-9:
            out.add((ka, min(a, b), max(a, b)))
    return out


def got(df, **kw):
    found = near.members(df).cache()
    rows = [tuple(r) for r in near.row_pairs(found, near.class_pairs(found, **kw)).collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_equals_all_pairs(spark):
    rows = some(random.Random(7))
    want = plain(rows, 0.8, 40)
    assert len(want) > 50
    assert got(spark.createDataFrame(rows, SCHEMA)) == want


def test_meetings_split_into_chunks(spark):
    rows = some(random.Random(8), families=4)
    assert got(spark.createDataFrame(rows, SCHEMA), chunk=3) == plain(rows, 0.8, 40)


def test_meeting_answers_equal_counting():
    """Whatever the shared element, a meeting finds the pairs that have it as their first in common, and counts right."""
    rng = random.Random(5)
    sets = []
    for i in range(60):
        xs = set(range(100))
        for _ in range(rng.randint(0, 20)):
            xs.symmetric_difference_update({rng.randint(0, 160)})
        sets.append((i, sorted(xs)))
    seen = led = 0
    for e in range(0, 12):
        m = near.Meeting([(c, xs, len(xs), xs.index(e)) for c, xs in sets if e in xs], 0.8)
        led += sum(m.leader(i, [(j, {}) for j in range(max(0, i - 8), i)]) is not None for i in range(len(m.sets)))
        got = {(i, j): c for i, j, c in m.answers()}
        for i in range(len(m.sets)):
            for j in range(i):
                c = len(m.own[i] & m.own[j])
                if c >= 0.8 * (m.sizes[i] + m.sizes[j] - c) - 1e-9 and min(m.own[i] & m.own[j]) == e:
                    assert got.pop((i, j)) == c
                    seen += 1
        assert all(c == len(m.own[i] & m.own[j]) for (i, j), c in got.items())
    assert seen > 100 and led > 100


def test_edges(spark):
    text = " ".join(f"w{i}" for i in range(40))
    assert got(spark.createDataFrame([], SCHEMA)) == set()
    rows = [("a", 1, None), ("a", 2, ""), ("a", 3, text), ("a", 4, text + " x"), ("b", 5, text), ("a", 3, text), ("a", 6, " ".join(text.split()[1:])), ("a", 7, "z " * 50_000)]
    assert got(spark.createDataFrame(rows, SCHEMA)) == {("a", 3, 4)}
    wide = spark.createDataFrame([("a", 1, text, 5), ("a", 2, text, 6)], SCHEMA + ", class int")
    assert got(wide) == {("a", 1, 2)}
    found = near.members(wide)
    assert [(r["class_key"], r["copies"], r["n_links"], r["n_rows"]) for r in near.links(found, near.class_pairs(found)).collect()] == [(1, 2, 0, 0)] * 2
    found = near.members(spark.createDataFrame([("a", 1, text), ("a", 2, text), ("a", 3, text + " x")], SCHEMA))
    assert sorted((r["key"], r["class_key"], r["copies"], r["n_links"], r["n_rows"]) for r in near.links(found, near.class_pairs(found)).collect()) == [(1, 1, 2, 1, 1), (2, 1, 2, 1, 1), (3, 3, 1, 1, 2)]
