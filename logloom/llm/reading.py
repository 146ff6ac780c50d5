"""Reading level of texts from the grades at which their words are acquired.

Fit, on a bounded sample of rated texts: every word has a distribution over the bands of the texts it stands in, each band
weighing the same; its mean is the word's acquisition grade. A text is described by quantiles of the grades of its known
words. The quantiles are calibrated against the ratings by ridge regression, and the limits between bands are those that
agree best with ratings of texts that the grades were not taken from. Scoring reads every word of every text."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rated texts that a fit reads at most; more are sampled by the hash of their id.
MOST_RATED = 20_000
QUANTILES = (0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 0.95)
BANDS = 5
FOLDS = 5
WORD = re.compile(r"[^\W\d_]+")


def words(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def word_grades(bags: list[Counter], ratings: np.ndarray) -> dict[str, float]:
    """Acquisition grade of each word: the mean band of its texts, bands weighing the same."""
    total, seen = np.zeros(BANDS), {}
    for bag, rating in zip(bags, ratings, strict=True):
        n = sum(bag.values())
        for band in {int(np.floor(rating)), int(np.ceil(rating))}:
            part = 1.0 if rating == int(rating) else 0.5
            total[band - 1] += part
            for w, k in bag.items():
                if w not in seen:
                    seen[w] = np.zeros(BANDS)
                seen[w][band - 1] += part * k / n
    weight = np.divide(1.0, total, out=np.zeros(BANDS), where=total > 0)
    out = {}
    for w, v in seen.items():
        p = v * weight + 1e-6 * (total > 0)
        out[w] = float(p @ np.arange(1, BANDS + 1) / p.sum())
    return out


def profile(bag: Counter, grades: dict[str, float]) -> tuple[np.ndarray, int]:
    """Quantiles and mean of the grades of a bag's known words, with their number."""
    known = [(grades[w], k) for w, k in bag.items() if w in grades]
    if not known:
        return np.zeros(len(QUANTILES) + 2), 0
    v, k = np.array(known).T
    order = np.argsort(v, kind="stable")
    v, k = v[order], k[order]
    upto = np.cumsum(k)
    at = np.searchsorted(upto, np.array(QUANTILES) * upto[-1])
    return np.append(v[np.minimum(at, len(v) - 1)], [v @ k / upto[-1], 1.0]), int(upto[-1])


def _ridge(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.linalg.solve(x.T @ x + 0.1 * np.eye(x.shape[1]), x.T @ y)


def _limits(level: np.ndarray, ratings: np.ndarray) -> list[float]:
    """The limits between bands with the fewest ratings on the wrong side; in the middle of equally good ones."""
    out = []
    for band in range(1, BANDS):
        grid = np.linspace(band + 0.1, band + 0.9, 81)
        wrong = np.array([np.sum((level >= g) != (ratings > band)) for g in grid])
        out.append(float(np.mean(grid[wrong == wrong.min()])))
    return out


def fit_model(texts: list[str], ratings: np.ndarray) -> tuple[dict[str, float], np.ndarray, list[float]]:
    """(grades, coefficients, limits). Levels for calibration come from grades of the other folds."""
    bags = [Counter(words(t)) for t in texts]
    kept = [i for i, b in enumerate(bags) if b]
    bags, ratings = [bags[i] for i in kept], ratings[kept]
    if len(bags) < 2 * FOLDS:
        return word_grades(bags, ratings) if bags else {}, np.append(np.zeros(len(QUANTILES)), [1.0, 0.0]), [b + 0.5 for b in range(1, BANDS)]
    fold = np.arange(len(bags)) % FOLDS
    x = np.zeros((len(bags), len(QUANTILES) + 2))
    for f in range(FOLDS):
        grades = word_grades([b for b, g in zip(bags, fold, strict=True) if g != f], ratings[fold != f])
        for i in np.flatnonzero(fold == f):
            x[i] = profile(bags[i], grades)[0]
    level = np.zeros(len(bags))
    for f in range(FOLDS):
        level[fold == f] = x[fold == f] @ _ridge(x[fold != f], ratings[fold != f])
    return word_grades(bags, ratings), _ridge(x, ratings), _limits(level, ratings)


def _fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    frames = list(batches)
    rated = pd.concat(frames).sort_values("doc_id") if frames else pd.DataFrame({"doc_id": [], "text": [], "rating": []})
    if len(rated):
        grades, coefficients, limits = fit_model(list(rated["text"]), rated["rating"].to_numpy(dtype=float))
        yield pd.DataFrame({"words": [list(grades)], "grades": [list(grades.values())], "coefficients": [coefficients.tolist()], "limits": [limits]})


def fit(documents: DataFrame, labels: DataFrame, most: int = MOST_RATED):
    """The model of documents(doc_id, text) with labels(doc_id, band_a, band_b), or None without a usable label.

    A rating is the mean of the bands that are given and lie between 1 and 5; labels of one document are averaged; labels
    without document and documents without words don't count."""
    band = lambda c: F.when(F.col(c).between(1, BANDS), F.col(c))
    rating = F.coalesce((band("band_a") + band("band_b")) / 2.0, band("band_a"), band("band_b"))
    rated = labels.select("doc_id", rating.alias("rating")).where("rating is not null").groupBy("doc_id").agg(F.avg("rating").alias("rating"))
    rated = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    # Bounded by `most`, so the texts stay where they are.
    sample = documents.select("doc_id", "text").where("text is not null").join(F.broadcast(rated), "doc_id").dropDuplicates(["doc_id"])
    sample = sample.withColumn("rating", F.round(F.col("rating") * 2) / 2)
    schema = "words array<string>, grades array<double>, coefficients array<double>, limits array<double>"
    rows = sample.repartition(1).mapInPandas(_fit, schema).collect()  # one row; the sample is bounded
    if not rows:
        return None
    r = rows[0]
    return dict(zip(r["words"], r["grades"], strict=True)), np.array(r["coefficients"]), list(r["limits"])


def levels(documents: DataFrame, model) -> DataFrame:
    """doc_id, level, band, known: estimate of every document, on the scale of the ratings, and how many words it rests on.

    Texts without a known word (null and empty ones too) have a null level and band. Repeated documents give repeated rows."""
    grades, coefficients, limits = model if model is not None else ({}, None, [])

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, text in zip(batch["doc_id"], batch["text"], strict=True):
                x, n = profile(Counter(words(text)), grades)
                level = float(x @ coefficients) if n else None
                rows.append((d, level, None if level is None else 1 + sum(level >= t for t in limits), n))
            yield pd.DataFrame(rows, columns=["doc_id", "level", "band", "known"]).astype({"level": "float64", "band": "Int32"})

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInPandas(score, f"doc_id {kind}, level double, band int, known bigint")
