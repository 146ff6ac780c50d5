"""Reading levels on made-up graded texts: held-out accuracy and edge cases."""

import random

from logloom.llm import reading

DOCS, LABELS = "doc_id bigint, text string", "doc_id bigint, band_a int, band_b int"


def graded(n, seed):
    rng, docs, bands = random.Random(seed), [], []
    easy, hard = [f"e{chr(97 + i)}" for i in range(20)], [f"hard{chr(97 + i)}" for i in range(20)]
    for d in range(n):
        band = rng.randint(1, 5)
        docs.append((d, " ".join(rng.choice(hard if rng.random() < (band - 1) / 4.5 else easy) for _ in range(rng.randint(60, 120)))))
        bands.append(band)
    return docs, bands


def test_held_out_bands(spark):
    docs, bands = graded(400, 1)
    labels = [(d, b, b if d % 3 else None) for d, b in enumerate(bands) if d < 200]
    labels[5] = (5, min(5, bands[5] + 1), bands[5])
    df = spark.createDataFrame(docs, DOCS)
    got = {r["doc_id"]: r["band"] for r in reading.levels(df, reading.fit(df, spark.createDataFrame(labels, LABELS))).collect()}
    right = sum((got[d] >= 4) == (bands[d] >= 4) for d in range(200, 400))
    assert right >= 185 and sum(got[d] == bands[d] for d in range(200, 400)) >= 140


def test_edges(spark):
    docs, bands = graded(60, 2)
    df = spark.createDataFrame(docs + [(900, None), (901, ""), (902, "12 34 !"), (903, "zzz unknown"), (904, docs[0][1] * 2000), (0, docs[0][1])], DOCS)
    model = reading.fit(df, spark.createDataFrame([(d, b, None) for d, b in enumerate(bands)] + [(777, 3, 3), (0, None, None), (1, 9, 0)], LABELS))
    rows = reading.levels(df, model).collect()
    got = {r["doc_id"]: r for r in rows}
    assert len(rows) == 66 and all(got[i]["band"] is None for i in (900, 901, 902, 903)) and got[904]["band"] == got[0]["band"]
    assert reading.fit(df, spark.createDataFrame([], LABELS)) is None
    assert all(r["band"] is None for r in reading.levels(df, None).collect())
    empty = spark.createDataFrame([], DOCS)
    assert reading.levels(empty, model).collect() == [] and reading.fit(empty, spark.createDataFrame([(1, 2, 3)], LABELS)) is None


def test_sample_is_bounded(spark):
    docs, bands = graded(60, 3)
    df = spark.createDataFrame(docs, DOCS)
    grades, _, _ = reading.fit(df, spark.createDataFrame([(d, b, b) for d, b in enumerate(bands)], LABELS), most=3)
    assert grades
