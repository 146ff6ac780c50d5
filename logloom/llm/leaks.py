"""Evaluation items inside a training corpus, by suffix arrays over shards of the corpus.

A shard is a run of documents inside one task. Its words become numbers of the items' vocabulary, 0 for any other word. The
suffix array of the shard holds all suffixes of the stretches without 0, in order, by prefix doubling. Every suffix of every
item is searched in it by bisection, which gives the range of all places that share its least length; where a match could
begin a word earlier, it belongs to the suffix before. The others are lengthened, all places of a range at once, to the
longest verbatim match. Items are a stated query set: they go to the tasks in blocks, each against all documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words that a passage has at least, words of a shard at most (plus one document), words of the items of a block (plus one).
LEAST, SHARD_WORDS, BLOCK_WORDS = 12, 1_000_000, 1_000_000
WORD = re.compile(rb"[a-z0-9]+")


def words(text: str | None) -> list[bytes]:
    """Longest runs of ASCII letters and digits, in lower case."""
    return WORD.findall(text.encode("utf-8", "replace").lower()) if text else []


def suffix_array(numbers: np.ndarray, least: int) -> np.ndarray:
    """Positions with `least` words before the next 0, in the order of all words up to that 0; equal ones by position.

    Ranks by one word are doubled to ranks by 2, 4, ... words; only positions that still tie are sorted again. Each 0 is a
    word of its own, smaller than all others and the smaller the further to the front."""
    n = len(numbers)
    zeros = np.flatnonzero(numbers == 0)
    ends, begins = np.append(zeros, n), np.append(-1, zeros) + 1
    stretch = np.searchsorted(zeros, np.arange(n))
    kept = np.flatnonzero((ends - begins)[stretch] >= least) if n else zeros
    # Stretches that are long enough, each with the 0 at its end.
    kept = kept[numbers[kept] != 0] if len(kept) else kept
    if not len(kept):
        return np.zeros(0, dtype=np.int64)
    last = np.append(np.diff(stretch[kept]) != 0, True)
    at = np.arange(len(kept)) + np.cumsum(last) - last
    m = len(kept) + int(last.sum())
    origin, rank = np.full(m, -1, dtype=np.int64), np.zeros(m, dtype=np.int64)
    origin[at] = kept
    rank[at] = numbers[kept] + m
    rank[origin < 0] = np.arange(m - len(kept))
    tied, k, base = np.arange(m), 0, np.int64(int(rank.max()) + 2)
    start = np.zeros(m, dtype=np.int64)  # of each position's group in the order so far
    while len(tied):
        if k:
            after = tied + k
            second = np.where(after < m, start[np.minimum(after, m - 1)] + 1, 0)
        else:
            second = rank
        key = start[tied] * base + second
        order = np.argsort(key)
        tied, key = tied[order], key[order]
        group = start[tied]
        fresh, older = np.append(True, key[1:] != key[:-1]), np.append(True, group[1:] != group[:-1])
        where = np.arange(len(tied))
        first, front = np.maximum.accumulate(np.where(fresh, where, 0)), np.maximum.accumulate(np.where(older, where, 0))
        start[tied] = group + first - front
        alone = fresh & np.append(fresh[1:], True)
        tied, k = tied[~alone], 2 * k or 1
    array = np.empty(m, dtype=np.int64)
    array[start] = origin
    array = array[array >= 0]
    return array[ends[stretch[array]] - array >= least]


def _windows(numbers: np.ndarray, at: np.ndarray, least: int) -> np.ndarray:
    """The `least` words from each position on, as bytes that compare as the words do."""
    raw = np.lib.stride_tricks.sliding_window_view(numbers.astype(">u4").view(np.uint8), 4 * least)
    return np.ascontiguousarray(raw[4 * at]).view(f"S{4 * least}").ravel()


def longest(text: np.ndarray, places: np.ndarray, item: np.ndarray, p: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Of places where item[p : p + least] stands those where no match begins a word earlier, and the length of the match."""
    if p:
        places = places[(places == 0) | (text[places - 1] != item[p - 1])]
    size, going, n = np.full(len(places), least), np.arange(len(places)), least
    while len(going) and p + n < len(item):
        at = places[going] + n
        going = going[(at < len(text)) & (text[np.minimum(at, len(text) - 1)] == item[p + n])]
        n += 1
        size[going] = n
    return places, size


def matches(numbers: np.ndarray, starts: np.ndarray, items: list[np.ndarray], least: int) -> pd.DataFrame:
    """doc, item, n_words, doc_word, item_word: the longest match of each document and item, by their places in starts and items."""
    columns = ["doc", "item", "n_words", "doc_word", "item_word"]
    array = suffix_array(numbers, least)
    own = [i for i, seq in enumerate(items) if len(seq) >= least]
    if not len(array) or not own:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    keys = _windows(numbers, array, least)
    asked = np.concatenate([_windows(items[i], np.arange(len(items[i]) - least + 1), least) for i in own])
    which = np.concatenate([np.full(len(items[i]) - least + 1, i) for i in own])
    word = np.concatenate([np.arange(len(items[i]) - least + 1) for i in own])
    low, high = np.searchsorted(keys, asked, "left"), np.searchsorted(keys, asked, "right")
    parts = []
    for h in np.flatnonzero(high > low):
        i, p = int(which[h]), int(word[h])
        places, size = longest(numbers, array[low[h] : high[h]], items[i], p, least)
        if len(places):
            doc = np.searchsorted(starts, places, side="right") - 1
            parts.append(np.stack([doc, np.full(len(doc), i), size, places - starts[doc], np.full(len(doc), p)], axis=1))
    rows = pd.DataFrame(np.concatenate(parts) if parts else np.zeros((0, 5), dtype=np.int64), columns=columns)
    return rows.sort_values(["doc", "item", "n_words", "doc_word", "item_word"], ascending=[True, True, False, True, True]).drop_duplicates(["doc", "item"])


def _search(items: list[tuple[int, list[bytes]]], least: int, shard_words: int):
    vocabulary = {w: i for i, w in enumerate(sorted({w for _, ws in items for w in ws}), 1)}
    ids, coded = [i for i, _ in items], [np.array([vocabulary[w] for w in ws], dtype=np.int64) for _, ws in items]

    def probe(docs: list, numbers: list[int], starts: list[int]) -> pd.DataFrame:
        found = matches(np.array(numbers, dtype=np.int64), np.array(starts, dtype=np.int64), coded, least)
        found.insert(0, "item_id", pd.Series([ids[i] for i in found["item"]], index=found.index, dtype=object))
        found.insert(0, "doc_id", pd.Series([docs[i] for i in found["doc"]], index=found.index, dtype=object))
        return found.drop(columns=["doc", "item"])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        docs, numbers, starts = [], [], []
        get = vocabulary.get
        for batch in batches:
            for d, text in zip(batch["doc_id"], batch["text"], strict=True):
                docs.append(d)
                starts.append(len(numbers))
                numbers += [get(w, 0) for w in words(text)]
                numbers.append(0)
                if len(numbers) >= shard_words:
                    yield probe(docs, numbers, starts)
                    docs, numbers, starts = [], [], []
        if docs:
            yield probe(docs, numbers, starts)

    return scan


def find(documents: DataFrame, items: DataFrame, least: int = LEAST, shard_words: int = SHARD_WORDS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, n_words, doc_word, item_word: the longest passage of at least `least` words that an item of
    items(item_id, item_text) shares with a document of documents(doc_id, text), and where it begins in either.

    One row per pair; of passages of equal length the first in the document counts, then the first in the item. Null, empty
    and shorter texts share none; documents that come twice give one row; no documents or no items give no rows. Items are
    read by the driver in blocks of block_words words; each block is a pass over the documents."""
    kind = {c: t for c, t in (*documents.dtypes, *items.dtypes)}
    schema = f"doc_id {kind['doc_id']}, item_id {kind['item_id']}, n_words bigint, doc_word bigint, item_word bigint"
    out, rows, held = None, [], 0

    def against(rows: list) -> DataFrame:
        return documents.select("doc_id", "text").mapInPandas(_search(rows, least, shard_words), schema)

    for r in items.select("item_id", "item_text").toLocalIterator():
        rows.append((r["item_id"], words(r["item_text"])))
        held += len(rows[-1][1])
        if held >= block_words:
            out, rows, held = (against(rows) if out is None else out.unionByName(against(rows))), [], 0
    if rows or out is None:
        out = against(rows) if out is None else out.unionByName(against(rows))
    best = F.max_by(F.struct("n_words", "doc_word", "item_word"), F.struct("n_words", -F.col("doc_word"), -F.col("item_word")))
    return out.groupBy("doc_id", "item_id").agg(best.alias("m")).select("doc_id", "item_id", "m.*")


def cleaned(documents: DataFrame, found: DataFrame) -> DataFrame:
    """The documents that hold no passage of an item."""
    return documents.join(found.select("doc_id").distinct(), "doc_id", "left_anti")
