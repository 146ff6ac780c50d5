"""A mixture of sources at target shares, as a flow of tokens from documents to sources.

Copies of a text may stand in several sources. Texts are grouped by the set of sources that they stand in (membership
pattern). A min-cost flow routes the tokens of the patterns to the quotas of the sources; using a text once more costs more
than the time before, so repetition starts where it must. The graph has a node per pattern and source and doesn't grow with
the documents. Texts are then drawn in a seeded order, by cutting the cumulative size at the flow. What the borders of texts
leave of a quota is made up by single texts of a fitting size, a few aggregations over the sizes."""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logloom.functions.hosts import norm_word
from logloom.functions.session import sized, stored

#: Where the ranks of the tokenizer are, unless the session's spark.logloom.tokenizer names another file.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pattern by which that tokenizer splits a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets of the seeded order in which sizes are summed up.
BUCKETS = 4096
#: Times that each source may change a text to come closer to its quota, the part of the quota that is close enough, and how
#: many of its texts are tried as the one to give up for another.
ROUNDS, NEAR, SWAPS = 4, 0.0005, 16


def _counter(ranks_file: bytes, pattern: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks_file.splitlines())}
        encoding = tiktoken.Encoding("public", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        for batch in batches:
            yield batch.drop(columns="text").assign(tokens=[len(encoding.encode_ordinary(t)) if t else 0 for t in batch["text"]])

    return count


def token_counts(documents: DataFrame, tokenizer: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """doc_id, source, digest, tokens: the size of every text under the tokenizer in a file of ranks."""
    with open(tokenizer or documents.sparkSession.conf.get("spark.logloom.tokenizer", TOKENIZER), "rb") as f:
        ranks = f.read()
    kind = documents.schema["doc_id"].dataType.simpleString()
    source = F.coalesce(F.when(norm_word("source") != "", norm_word("source")), F.lit(""))
    rows = documents.select("doc_id", source.alias("source"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    return rows.mapInPandas(_counter(ranks, pattern), f"doc_id {kind}, source string, digest string, tokens bigint")


class Flow:
    """Min-cost flow by successive cheapest paths; the graphs here have a few hundred edges."""

    def __init__(self, n: int):
        self.edges: list[list] = []
        self.at: list[list[int]] = [[] for _ in range(n)]

    def add(self, a: int, b: int, capacity: int, cost: int) -> int:
        self.at[a].append(len(self.edges))
        self.edges.append([b, capacity, cost])
        self.at[b].append(len(self.edges))
        self.edges.append([a, 0, -cost])
        return len(self.edges) - 2

    def run(self, s: int, t: int) -> int:
        total = 0
        while True:
            best, via, queue, queued = {s: 0}, {}, deque([s]), {s}
            while queue:
                a = queue.popleft()
                queued.discard(a)
                for e in self.at[a]:
                    b, capacity, cost = self.edges[e]
                    if capacity > 0 and best[a] + cost < best.get(b, 1 << 60):
                        best[b], via[b] = best[a] + cost, e
                        if b not in queued:
                            queue.append(b)
                            queued.add(b)
            if t not in best:
                return total
            path, b = [], t
            while b != s:
                path.append(via[b])
                b = self.edges[via[b] ^ 1][0]
            push = min(self.edges[e][1] for e in path)
            for e in path:
                self.edges[e][1] -= push
                self.edges[e ^ 1][1] += push
            total += push


def route(patterns: dict[tuple[str, ...], int], targets: dict[str, tuple[float, int]], total: int | None = None) -> dict[tuple[tuple[str, ...], str], int]:
    """Tokens that each pattern gives to each source. Without total, as many as leave all shares at their targets.

    Sources without tokens get none, and the shares of the others are scaled up. A text of several sources is repeated no
    more often than the least of them allows."""
    live = [s for s in sorted(targets) if targets[s][0] > 0 and targets[s][1] > 0 and any(s in p and n for p, n in patterns.items())]
    if not live:
        return {}
    scale = sum(targets[s][0] for s in live)
    pats = sorted(p for p in patterns if patterns[p] and any(s in live for s in p))

    def attempt(size: int) -> tuple[bool, dict]:
        flow, node = Flow(2 + len(pats) + len(live)), {s: 2 + len(pats) + i for i, s in enumerate(live)}
        edges = {}
        for i, p in enumerate(pats):
            own = [s for s in p if s in live]
            for k in range(min(targets[s][1] for s in own)):
                flow.add(0, 2 + i, patterns[p], k)
            for s in own:
                edges[p, s] = flow.add(2 + i, node[s], 1 << 60, 0)
        quotas = {s: int(size * targets[s][0] / scale) for s in live}
        for s in live:
            flow.add(node[s], 1, quotas[s], 0)
        reached = flow.run(0, 1)
        return reached == sum(quotas.values()), {k: flow.edges[e ^ 1][1] for k, e in edges.items()}

    if total is not None:
        return attempt(total)[1]
    low, high = 0, int(min(sum(n * max(targets[s][1] for s in live) for n in patterns.values()) * scale / targets[s][0] for s in live)) + 1
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if attempt(middle)[0] else (low, middle)
    return attempt(low)[1]


def select(sizes: DataFrame, targets: DataFrame, total: int | None = None, seed: int = 7, buckets: int = BUCKETS) -> DataFrame:
    """doc_id, source, tokens, uses of the chosen documents of token_counts() for targets(source, target_share, max_repeats).

    Of the copies of a text the least doc_id stands for all of them; it counts for the source that it is drawn for. Texts
    without source or tokens aren't chosen; sources without target get nothing; a target without documents stays empty;
    no documents or targets give no rows. A text belongs to the quota in which its middle lies; then each source adds
    or gives up texts, or changes one for another, as long as that brings it closer to its quota, ROUNDS times at most."""
    spark = sizes.sparkSession
    name = norm_word("source")
    wanted = {r["s"]: (float(r["share"] or 0), int(r["most"] or 0)) for r in targets.groupBy(name.alias("s")).agg(F.sum("target_share").alias("share"), F.min("max_repeats").alias("most")).collect() if r["s"]}  # a row per source
    texts = sizes.where("source != '' and tokens > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("tokens").alias("tokens"), F.array_sort(F.collect_set("source")).alias("sources"))
    texts = texts.withColumn("pattern", F.filter("sources", lambda s: s.isin(*(wanted or [""])))).where("size(pattern) > 0")
    texts = stored(texts.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id")).withColumn("bucket", F.floor((F.col("draw") / 2.0**64 + 0.5) * buckets).cast("int")).select("doc_id", "tokens", "pattern", "draw", "bucket"), "mix-texts")
    sums = {tuple(r["pattern"]): int(r["n"]) for r in texts.groupBy("pattern").agg(F.sum("tokens").alias("n")).collect()}  # a row per set of sources
    given = route(sums, wanted, total)
    rows, upto = [], dict.fromkeys(sums, 0)
    for (p, s), n in sorted(given.items()):
        if n:
            rows.append((list(p), s, upto[p], upto[p] + n))
            upto[p] += n
    kind = sizes.schema["doc_id"].dataType.simpleString()
    if not rows:
        return spark.createDataFrame([], f"doc_id {kind}, source string, tokens bigint, uses bigint")
    cuts = F.broadcast(spark.createDataFrame(rows, "pattern array<string>, source string, low bigint, high bigint"))  # patterns x sources
    # Where each text begins in the drawn order: its bucket's start, a sum over few rows, plus its place in the bucket.
    per = texts.groupBy("pattern", "bucket").agg(F.sum("tokens").alias("n"))
    start = per.select("pattern", "bucket", (F.sum("n").over(Window.partitionBy("pattern").orderBy("bucket")) - F.col("n")).alias("start"), F.sum("n").over(Window.partitionBy("pattern")).alias("whole"))
    inside = Window.partitionBy("pattern", "bucket").orderBy("draw", "doc_id")
    placed = texts.withColumn("in_bucket", F.sum("tokens").over(inside) - F.col("tokens")).join(sized(start, "mix-starts"), ["pattern", "bucket"])
    # The tokens of a pattern laid end to end, again and again: a text is used for a source once for each lap on which its
    # middle lies between the source's cuts. Laps: those l with low <= middle + l * whole < high. In halves of a token.
    middle = 2 * (F.col("start") + F.col("in_bucket")) + F.col("tokens")
    ceiling = lambda c: -F.call_function("div", -c - F.pmod(-c, 2 * F.col("whole")), 2 * F.col("whole"))
    first, after = ceiling(2 * F.col("low") - middle), ceiling(2 * F.col("high") - middle)
    uses = F.greatest(F.lit(0), after - F.greatest(first, F.lit(0)))
    chosen = stored(placed.join(cuts, "pattern").select("doc_id", "source", "tokens", "draw", uses.alias("uses")).where("uses > 0"), "mix-chosen")
    quotas: dict[str, int] = {}
    for (_, s), n in given.items():
        quotas[s] = quotas.get(s, 0) + n
    changes = spark.createDataFrame(_fitted(texts, chosen, quotas, {s: most for s, (_, most) in wanted.items()}), f"doc_id {kind}, source string, tokens bigint, uses bigint")
    return chosen.drop("draw").unionByName(changes).groupBy("doc_id", "source").agg(F.first("tokens").alias("tokens"), F.sum("uses").alias("uses")).where("uses > 0")


def _fitted(texts: DataFrame, chosen: DataFrame, quotas: dict[str, int], most: dict[str, int]) -> list[tuple]:
    """(doc_id, source, tokens, 1 or -1): texts that sources add or give up, two a source and round at most.

    Each round is one aggregation: of every source that isn't close to its quota, the text to add, to give up, or to add for
    one given up, that comes closest. Large quotas are close from the start."""
    have = {r["source"]: int(r["n"]) for r in chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("n")).collect()}  # a row per source
    lacks = {s: n - have.get(s, 0) for s, n in quotas.items()}
    far = lambda: [s for s, r in sorted(lacks.items()) if abs(r) > NEAR * quotas[s]]
    if not far():
        return []
    spark, kind = texts.sparkSession, texts.schema["doc_id"].dataType.simpleString()
    limit = F.create_map(*[F.lit(x) for s, n in most.items() for x in (s, n)])
    used = chosen.groupBy("doc_id").agg(F.sum("uses").alias("used"))
    free = texts.join(used, "doc_id", "left").where(F.coalesce("used", F.lit(0)) < F.array_min(F.transform("pattern", lambda s: F.try_element_at(limit, s))))
    moves = free.select("doc_id", F.explode("pattern").alias("source"), "tokens", "draw", F.lit(1).alias("sign")).unionByName(chosen.select("doc_id", "source", "tokens", "draw", F.lit(-1).alias("sign")))
    moves = stored(moves.where(F.col("source").isin(far())), "mix-moves")
    nth = F.row_number().over(Window.partitionBy("source").orderBy("draw", "doc_id"))
    tried = [tuple(r) for r in moves.where("sign = -1").withColumn("nth", nth).where(F.col("nth") <= SWAPS).select("source", "doc_id", "tokens").collect()]  # SWAPS rows a source
    out: list[tuple] = []
    for _ in range(ROUNDS):
        changed = {r[0] for r in out}
        bases = [(s, None, lacks[s]) for s in far()] + [(s, d, lacks[s] + n) for s, d, n in tried if s in far() and d not in changed]
        if not bases:
            break
        base = F.broadcast(spark.createDataFrame(bases, f"source string, gone {kind}, lack bigint"))
        m = moves.join(base, "source").where("gone is null or (sign = 1 and doc_id != gone)").where(~F.col("doc_id").isin(list(changed)) if changed else F.lit(True))
        error = F.abs(F.col("lack") - F.col("sign") * F.col("tokens"))
        best = m.groupBy("source").agg(F.min_by(F.struct("doc_id", "tokens", "sign", "gone", "lack"), F.struct(error, F.col("gone").isNotNull(), "draw", "doc_id", "gone")).alias("m")).select("source", "m.*").collect()
        taken: set = set()
        for r in sorted(best, key=lambda r: r["source"]):
            s, after = r["source"], r["lack"] - r["sign"] * r["tokens"]
            if abs(after) < abs(lacks[s]) and not taken & {r["doc_id"], r["gone"]}:
                out.append((r["doc_id"], s, r["tokens"], r["sign"]))
                if r["gone"] is not None:
                    out.append((r["gone"], s, r["lack"] - lacks[s], -1))
                taken |= {r["doc_id"], r["gone"]} - {None}
                lacks[s] = after
        if not taken:
            break
    return out


def report(chosen: DataFrame, targets: DataFrame) -> DataFrame:
    """source, target_share, goal, max_repeats, n_documents, tokens, share, most_uses of every target: what was reached.

    goal is the target's part of the targets that have documents; it is 0 where a source has none."""
    t = targets.select(norm_word("source").alias("source"), "target_share", "max_repeats")
    got = chosen.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum(F.col("tokens") * F.col("uses")).alias("tokens"), F.max("uses").alias("most_uses"))
    rows = t.join(got, "source", "left")
    live = F.when(F.col("tokens") > 0, F.col("target_share")).otherwise(0.0)
    whole = rows.agg(F.sum("tokens").alias("whole"), F.sum(live).alias("scale"))
    rows = rows.crossJoin(F.broadcast(whole))  # one row
    zero = F.lit(0).cast("bigint")
    return rows.select("source", "target_share", F.coalesce(F.try_divide(live, F.col("scale")), F.lit(0.0)).alias("goal"), "max_repeats", F.coalesce("n_documents", zero).alias("n_documents"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce(F.try_divide("tokens", "whole"), F.lit(0.0)).alias("share"), F.coalesce("most_uses", zero).alias("most_uses"))


def kept(reached: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """source, share_kept, repeats_kept of report(): whether the share is within the tolerance of its goal and no text is used too often."""
    return reached.select("source", (F.abs(F.col("share") - F.col("goal")) <= tolerance).alias("share_kept"), (F.col("most_uses") <= F.col("max_repeats")).alias("repeats_kept"))
