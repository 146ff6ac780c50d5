"""Runs of alike consecutive events, folded by adjacent agglomeration.

Events are ordered by host, instant and id and cut into ranges of about equal size: a host that holds a third of all events
spreads over many ranges. Each range is agglomerated alone: its runs form a linked list, a priority queue holds the pairs
of neighbours that may merge, the most similar pair merges first, until none meets the limits of similarity and gap. The
runs at the edges of ranges meet in a second pass, which sees a few rows per range and host.

The number of ranges follows the number of events. Within a range events are agglomerated HELD at a time: a cut falls where
nothing can merge, or behind a run that goes on; with the limit of alike kinds only that last run may still merge, and is
carried over. Lower limits may merge across any number of events without a pause, so there a whole range is held, which the
number of rows of a range bounds."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logloom.functions.session import stored

GAP_US = 600_000_000
#: Events of a range, and events that a task holds at a time where all kinds of a run are alike.
RANGE_ROWS, HELD = 500_000, 20_000
RUN = "host string, kinds array<string>, counts array<bigint>, first_us bigint, first_id bigint, last_us bigint, last_id bigint, n bigint, part int, edge boolean"
COLUMNS = ("host", "kinds", "counts", "first_us", "first_id", "last_us", "last_id", "n")


def similarity(a: dict[str, int], b: dict[str, int]) -> float:
    """Overlap of two runs' shares of event kinds: 1 for the same shares, 0 for none in common."""
    if len(a) == 1 and len(b) == 1:
        return float(a.keys() == b.keys())
    na, nb = sum(a.values()), sum(b.values())
    return sum(min(a[k] / na, b[k] / nb) for k in a.keys() & b.keys())


def agglomerate(runs: list[list], least: float, gap_us: int) -> list[list]:
    """Merge neighbours of [host, {kind: count}, first_us, first_id, last_us, last_id, n], which are in order.

    Pairs of equal similarity merge from the earliest on."""
    n = len(runs)
    after, before = list(range(1, n)) + [-1], [-1, *range(n - 1)]
    born, queue = [0] * n, []

    def offer(i: int, j: int) -> None:
        a, b = runs[i], runs[j]
        if a[0] == b[0] and b[2] - a[4] <= gap_us and (s := similarity(a[1], b[1])) >= least:
            queue.append((-s, i, j, born[i], born[j])) if not heaped else heapq.heappush(queue, (-s, i, j, born[i], born[j]))

    heaped = False
    for i in range(n - 1):
        offer(i, i + 1)
    heapq.heapify(queue)
    heaped = True
    gone = bytearray(n)
    while queue:
        _, i, j, bi, bj = heapq.heappop(queue)
        if gone[i] or gone[j] or born[i] != bi or born[j] != bj:
            continue
        a, b = runs[i], runs[j]
        for k, c in b[1].items():
            a[1][k] = a[1].get(k, 0) + c
        a[4], a[5], a[6] = b[4], b[5], a[6] + b[6]
        gone[j], born[i], after[i] = 1, born[i] + 1, after[j]
        if after[j] >= 0:
            before[after[j]] = i
            offer(i, after[i])
        if before[i] >= 0:
            offer(before[i], i)
    return [r for r, g in zip(runs, gone, strict=True) if not g]


def _frame(runs: list[list], part: int, edges: set[int]) -> pd.DataFrame:
    rows = [(h, list(k), list(k.values()), fu, fi, lu, li, n, part, i in edges) for i, (h, k, fu, fi, lu, li, n) in enumerate(runs)]
    return pd.DataFrame(rows, columns=[*COLUMNS, "part", "edge"])


def _ranges(least: float, gap_us: int):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held, first, last_key = TaskContext.get().partitionId(), [], True, None
        for batch in batches:
            for h, us, i, kind in zip(batch["host"], batch["us"], batch["id"], batch["kind"], strict=True):
                if (h, us, i) == last_key:
                    continue  # the same event again
                last_key = (h, us, i)
                # Nothing merges across another host or a gap that is too long: what lies before it is complete.
                apart = bool(held) and (held[-1][0] != h or us - held[-1][4] > gap_us)
                if len(held) > HELD and (apart or least >= 1):
                    runs = agglomerate(held, least, gap_us)
                    held = [] if apart else [runs.pop()]
                    if runs:
                        yield _frame(runs, part, {0} if first else set())
                        first = False
                held.append([h, {kind: 1}, us, i, us, i, 1])
        if held:
            runs = agglomerate(held, least, gap_us)
            yield _frame(runs, part, {len(runs) - 1} | ({0} if first else set()))

    return fold


def _edges(least: float, gap_us: int):
    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["first_us", "first_id"])
        runs = [[h, dict(zip(k, c, strict=True)), int(fu), int(fi), int(lu), int(li), int(n)] for h, k, c, fu, fi, lu, li, n in group[list(COLUMNS)].itertuples(index=False)]
        # Runs between two edges lie here as their neighbours only where they touch: a gap of unseen runs can't be bridged,
        # because edges of one range are neighbours only if they are all that it holds of the host.
        parts, out, chain, prev = list(group["part"]), [], [], None
        for r, p in zip(runs, parts, strict=True):
            if chain and p == prev:
                out += agglomerate(chain, least, gap_us)
                chain = []
            chain.append(r)
            prev = p
        out += agglomerate(chain, least, gap_us)
        return _frame(out, -1, set())

    return fold


def runs(events: DataFrame, least: float = 1.0, gap_us: int = GAP_US, partitions: int | None = None) -> DataFrame:
    """host, kinds, counts, first_us, first_id, last_us, last_id, n: the runs of events(host, us, id, kind).

    Neighbours merge if the overlap of their shares of kinds is at least `least` and they are no more than gap_us apart.
    Events without host or instant are left out; an id that comes twice at one instant of a host counts once; a null kind
    is the kind ''; equal instants are ordered by id. With least below 1 the order of merges at the edges of ranges may
    differ from that in one range; with 1 the result doesn't depend on the ranges."""
    rows = events.where("host is not null and us is not null").select("host", "us", "id", F.coalesce("kind", F.lit("")).alias("kind"))
    n = partitions or max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows.count() // RANGE_ROWS + 1)
    ranged = rows.repartitionByRange(n, "host", "us", "id").sortWithinPartitions("host", "us", "id")
    found = ranged.mapInPandas(_ranges(least, gap_us), RUN)
    found = stored(found, "runs")
    edge = found.where("edge").groupBy("host").applyInPandas(_edges(least, gap_us), RUN)
    return found.where("not edge").unionByName(edge).select(*COLUMNS)
