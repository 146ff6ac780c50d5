"""Texts whose words are nearly the same: an exact similarity join of word multisets.

A multiset is a set of numbered words (the second `port` of a text is another element than the first). Elements have a
global order, rare ones first, and are called by their rank in it; an element of one set alone can't be in common and counts
in the set's size only. Two sets at the threshold share an element within a prefix of each, so sets meet by prefix elements.
At a meeting

- the index lists the smaller sets in blocks by the position at which the element stands in them, each block by size; blocks
  that stand too far back to reach the threshold are skipped, and so are sizes outside of it;
- a set comes only where a partner of a fitting size may be, with enough behind the shared element in both;
- a set much like one before it, its leader, takes over the leader's candidates and their overlaps. What the leader's overlap
  and the difference of the two sets keep below the threshold is skipped unseen, the rest is corrected by the few elements
  in which the two differ, and only sets behind the leader are looked for in the index.

Equal multisets are one class; only classes meet. A meeting of more than CHUNK sets is split into pairs of chunks."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.session import ranked, stored

THRESHOLD, LEAST_WORDS = 0.8, 40
#: An element in at least this share of the classes is frequent; there are at most (mean size / FREQUENT) of them.
FREQUENT = 0.002
#: Sets of a meeting that one task takes.
CHUNK = 2_000
#: Sizes up to this factor apart are one step when partners of a fitting size are looked for.
STEP = 1.02
#: Leaders that a meeting remembers, and sets by which one may lie back.
LEADERS, REACH = 8, 256


def need(threshold: float, a: int, b: int) -> int:
    """Common elements that sets of a and b elements have at least at the threshold."""
    return math.ceil(threshold / (1 + threshold) * (a + b) - 1e-9)


def prefix(threshold: float, n: int) -> int:
    """Elements of a set of n of which one at least is in any similar set."""
    return n - math.ceil(threshold * n - 1e-9) + 1


def short_prefix(threshold: float, n: int) -> int:
    """The same towards sets that aren't smaller."""
    return n - need(threshold, n, n) + 1


def _number(least: int):
    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, str, int], int] = {}
        for batch in batches:
            rows = []
            for kind, key, ws in zip(batch["kind"], batch["key"], batch["words"], strict=True):
                if ws is None or len(ws) < least:
                    continue
                out = []
                for w, n in Counter(ws).items():
                    for k in range(n):
                        if (x := seen.get((kind, w, k))) is None:
                            x = int.from_bytes(blake2b(f"{kind}:{k}:{w}".encode(), digest_size=8).digest(), "big", signed=True)
                            if len(seen) < 500_000:
                                seen[kind, w, k] = x
                        out.append(x)
                out.sort()
                rows.append((kind, key, out, blake2b(b"".join(x.to_bytes(8, "big", signed=True) for x in out), digest_size=16).hexdigest()))
            yield pd.DataFrame(rows, columns=["kind", "key", "elements", "class"])

    return number


def members(texts: DataFrame, least: int = LEAST_WORDS) -> DataFrame:
    """kind, key, elements, class of texts(kind, key, text) with at least `least` words; equal multisets of a kind share a class.

    Elements of different kinds differ. Null texts are left out."""
    words = F.transform(F.regexp_extract_all(F.col("text"), F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower)
    return texts.where("text is not null").select("kind", "key", words.alias("words")).mapInPandas(_number(least), "kind string, key bigint, elements array<bigint>, class string")


class Meeting:
    """Sets that share an element, as (id, ranks of the elements that others have too, size, position of the shared element)."""

    def __init__(self, sets: list[tuple[int, list[int], int, int]], threshold: float):
        self.t, self.sets = threshold, sorted(sets, key=lambda s: (s[2], s[1], s[0]))
        self.sizes, self.own, self.at = [s[2] for s in self.sets], [frozenset(s[1]) for s in self.sets], [s[3] for s in self.sets]
        self.blocks: dict[int, list[int]] = defaultdict(list)
        for i, (_, _, size, at) in enumerate(self.sets):
            if at < short_prefix(threshold, size):
                self.blocks[at].append(i)  # by size, as the sets are
        self.order = sorted(self.blocks)

    def candidates(self, i: int, begin: int = 0) -> Iterator[int]:
        """Sets from begin on and before i that may be similar to it with the shared element as the first in common."""
        n, at = self.sizes[i], self.at[i]
        low = max(begin, bisect_left(self.sizes, math.ceil(self.t * n - 1e-9)))
        if low >= i or n - at < need(self.t, n, self.sizes[low]):
            return
        for back in self.order:
            if self.sizes[i] - back < need(self.t, n, self.sizes[low]):
                break  # this block and those behind it stand too far back, whatever the size
            block = self.blocks[back]
            for j in block[bisect_left(block, low) : bisect_left(block, i)]:
                least = need(self.t, n, self.sizes[j])
                if self.sizes[j] - back >= least and n - at >= least:
                    yield j

    def leader(self, i: int, leaders: list[tuple[int, dict[int, int]]]) -> tuple | None:
        """The newest leader much like i, with what i has more and less than it.

        As sets come by size, and if no more of i than of the leader stands behind the shared element, a set before the leader
        that may be similar to i is among the leader's candidates."""
        for at, known in reversed(leaders):
            if i - at > REACH:
                return None
            if self.sizes[i] - self.at[i] <= self.sizes[at] - self.at[at]:
                more, less = self.own[i] - self.own[at], self.own[at] - self.own[i]
                if 4 * (len(more) + len(less)) <= len(self.own[i]):
                    return at, known, more, less
        return None

    def answers(self) -> Iterator[tuple[int, int, int]]:
        """(i, j, common) of every similar pair j < i whose first common element may be the shared one."""
        leaders: list[tuple[int, dict[int, int]]] = []
        for i in range(len(self.sets)):
            own, n = self.own[i], self.sizes[i]
            if found := self.leader(i, leaders):
                begin, known, more, less = found
                for j, c in known.items():
                    least = need(self.t, n, self.sizes[j])
                    if c + len(more) >= least:
                        c += len(more & self.own[j]) - len(less & self.own[j])
                        if c >= least:
                            yield i, j, c
                for j in self.candidates(i, begin):
                    c = len(own & self.own[j])
                    if c >= need(self.t, n, self.sizes[j]):
                        yield i, j, c
                continue
            known = {}
            for j in self.candidates(i):
                known[j] = c = len(own & self.own[j])
                if c >= need(self.t, n, self.sizes[j]):
                    yield i, j, c
            leaders = [*leaders[1 - LEADERS :], (i, known)]


def _meet(threshold: float):
    def pairs(element: int, low: int, high: int, chunk: dict[int, int], sets: list) -> list[tuple]:
        meeting, rows = Meeting(sets, threshold), []
        # Elements of one set alone are the rarest: they stand in front and belong to the prefix.
        head = [frozenset(xs[: prefix(threshold, size) - (size - len(xs))]) for _, xs, size, _ in meeting.sets]
        for i, j, c in meeting.answers():
            (a, xs, n, _), (b, _, m, _) = meeting.sets[i], meeting.sets[j]
            if low != high and chunk[a] == chunk[b]:
                continue  # found where the chunk meets itself
            first = next(x for x in xs if x in head[j])
            if first == element:  # else the pair belongs to the meeting of an earlier element
                rows.append((a, b, c / (n + m - c)))
        return rows

    def meet(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Meetings follow each other: rows come sorted by them."""
        columns, at, chunk, sets = ["a", "b", "similarity"], None, {}, []
        for batch in batches:
            rows = []
            for element, low, high, c, i, size, xs, pos in zip(batch["element"], batch["low"], batch["high"], batch["chunk"], batch["id"], batch["size"], batch["xs"], batch["at"], strict=True):
                if at != (element, low, high):
                    if len(sets) > 1:
                        rows += pairs(*at, chunk, sets)
                    at, chunk, sets = (element, low, high), {}, []
                chunk[i] = c
                sets.append((i, xs.tolist(), size, pos))
            yield pd.DataFrame(rows, columns=columns)
        if len(sets) > 1:
            yield pd.DataFrame(pairs(*at, chunk, sets), columns=columns)

    return meet


def class_pairs(found: DataFrame, threshold: float = THRESHOLD, chunk: int = CHUNK) -> DataFrame:
    """kind, class_a, class_b, similarity of every pair of different classes of members() at the threshold."""
    classes = found.groupBy("kind", "class").agg(F.first("elements").alias("elements"))
    classes = stored(classes.withColumn("id", F.monotonically_increasing_id()), "classes")
    total = classes.count()
    held = classes.select("id", F.size("elements").alias("size"), F.explode("elements").alias("x"))
    ranks = ranked(held.groupBy("x").agg(F.count("*").alias("n")).where("n > 1"), ["n", "x"], "rank")
    ranks = stored(ranks.withColumn("rank", F.col("rank").cast("int")) if total < 1 << 24 else ranks, "element-ranks")
    # Bounded: each class has its elements, so at most (mean size / FREQUENT) elements are in that share of the classes.
    # Without the frequent ones no element is a hot key of the join.
    is_many = F.col("n") >= max(2.0, FREQUENT * total)
    many, few = F.broadcast(ranks.where(is_many).select("x", "rank")), ranks.where(~is_many).select("x", "rank")
    known = held.join(many, "x").unionByName(held.join(many.select("x"), "x", "left_anti").join(few, "x"))
    sets = stored(known.groupBy("id", "size").agg(F.array_sort(F.collect_list("rank")).alias("xs")), "sets")
    alone = F.col("size") - F.size("xs")
    head = F.col("size") - F.ceil(threshold * F.col("size") - 1e-9).cast("int") + 1 - alone
    short = F.col("size") - F.ceil(2 * threshold / (1 + threshold) * F.col("size") - 1e-9).cast("int") + 1
    heads = sets.where(head > 0).select("id", "size", short.alias("short"), alone.alias("alone"), F.posexplode(F.slice("xs", F.lit(1), F.least(head, F.size("xs")))).alias("i", "element"))
    heads = heads.select("id", "short", "size", (F.col("i") + F.col("alone")).alias("at"), "element")
    # A set of n elements with the shared one at p and a partner of m with it at q have n - p and m - q in common at most, and
    # c * (n + m) at least. So m is limited by n and p, and m - q - c * m, what the partner has to spare, reaches c * n. By
    # element and step of size the most that any set has to spare: a few hundred steps at most, whatever the element.
    c, size, at = threshold / (1 + threshold), F.col("size"), F.col("at")
    heads = heads.withColumns({"step": F.floor(F.log(size) / math.log(STEP)).cast("int"), "spare": size * (1 - c) - at})
    steps = heads.groupBy("element", "step").agg(F.count("*").alias("n"), F.max("spare").alias("spare"), F.count_if(at < F.col("short")).alias("front"))
    # A meeting needs a set that has the element far enough in front for those that aren't smaller.
    steps = steps.withColumns({"low": F.pow(F.lit(STEP), "step") * (1 - 1e-6), "high": F.pow(F.lit(STEP), F.col("step") + 1) * (1 + 1e-6)})
    shared = steps.groupBy("element").agg(F.sum("n").alias("n"), F.sum("front").alias("front"), F.collect_list(F.struct("step", "n", "spare", "low", "high")).alias("steps")).where("n > 1 and front > 0").drop("front")
    limits = {"least": threshold * size - 1e-6, "most": F.least(size / threshold, (size - at) / c - size) + 1e-6, "asked": c * size - 1e-6}
    fits = lambda s: (s["spare"] >= F.col("asked")) & (s["low"] <= F.col("most")) & (s["high"] >= F.col("least")) & ((s["step"] != F.col("step")) | (s["n"] > 1))
    live = heads.drop("short", "spare").join(shared, "element").withColumns(limits).where(F.exists("steps", fits)).select("id", "element", "at", "n")
    pieces = F.ceil(F.col("n") / chunk).cast("int")
    own = F.pmod(F.xxhash64("id"), pieces).cast("int")
    live = live.select("id", "element", "at", own.alias("chunk"), F.explode(F.sequence(F.lit(0), pieces - 1)).alias("other"))
    live = live.select("id", "element", "at", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    key = ["element", "low", "high"]
    met = live.join(sets, "id").repartition(*key).sortWithinPartitions(*key)
    similar = met.mapInPandas(_meet(threshold), "a bigint, b bigint, similarity double")
    name = classes.select("id", "kind", "class")
    similar = similar.join(name.select(F.col("id").alias("a"), "kind", F.col("class").alias("x")), "a").join(name.select(F.col("id").alias("b"), F.col("class").alias("y")), "b")
    return similar.select("kind", F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b"), "similarity")


def row_pairs(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, key_a, key_b of every similar pair of rows, smaller key first: those of similar classes and of one class."""
    at = found.select("kind", "class", "key").distinct()
    a = at.select("kind", F.col("class").alias("class_a"), F.col("key").alias("x"))
    b = at.select("kind", F.col("class").alias("class_b"), F.col("key").alias("y"))
    across = pairs.join(a, ["kind", "class_a"]).join(b, ["kind", "class_b"]).select("kind", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    within = a.join(b.withColumnRenamed("class_b", "class_a"), ["kind", "class_a"]).where("x < y").select("kind", F.col("x").alias("key_a"), F.col("y").alias("key_b"))
    return across.unionByName(within)


def links(found: DataFrame, pairs: DataFrame) -> DataFrame:
    """kind, key, class_key, copies, n_links, n_rows of every row: the least key of the rows with its multiset and their
    number, how many other multisets are similar to it, and how many rows have those."""
    copies = found.groupBy("kind", "class").agg(F.count("*").alias("copies"), F.min("key").alias("class_key"))
    both = pairs.select("kind", F.col("class_a").alias("class"), F.col("class_b").alias("to")).unionByName(pairs.select("kind", F.col("class_b").alias("class"), F.col("class_a").alias("to")))
    degree = both.join(copies.select("kind", F.col("class").alias("to"), F.col("copies").alias("n")), ["kind", "to"]).groupBy("kind", "class").agg(F.count("*").alias("n_links"), F.sum("n").alias("n_rows"))
    zero = F.lit(0).cast("bigint")
    rows = found.select("kind", "key", "class").join(copies, ["kind", "class"]).join(degree, ["kind", "class"], "left")
    return rows.select("kind", "key", "class_key", "copies", F.coalesce("n_links", zero).alias("n_links"), F.coalesce("n_rows", zero).alias("n_rows"))


def texts(log_event: DataFrame, action_item: DataFrame) -> DataFrame:
    """kind, key, text of the messages of log_event, unsplit rows left out, and of the samples of action_item."""
    split = ~F.coalesce((F.col("appname") == "syslog") & (F.col("timestamp") == ""), F.lit(False))
    logs = log_event.where(split).select(F.lit("log_event").alias("kind"), F.col("seq").alias("key"), F.col("message").alias("text"))
    return logs.unionByName(action_item.select(F.lit("action_item").alias("kind"), F.col("item_id").alias("key"), F.concat_ws(" ", "sample_messages").alias("text")))
