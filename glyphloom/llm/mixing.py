"""Mixing sources to target weights by Pfair scheduling.

Each source's rows form blocks. A source of weight w (a share of all slots) has
its k-th block released at floor((k - 1) / w), due at ceil(k / w); of the
released blocks, the one with the earliest deadline takes the next slot. Every
source then stays within one block of its due share at any time.

Weights are whole numbers m of a period of M slots, and the schedule repeats
after M slots. In the slot after a source's last block the others go on with
their weights: a new phase, with a schedule of its own. So the weights hold until
a source is dry, and each phase needs the places of min(its slots, one period).
One task works them out from the sizes of the sources, as a stream; blocks then
look up their slots in an equi-join. None is dropped or repeated, and no task
gathers a source's rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from glyphloom.llm.common import rowed, sized, staged, table

#: Rows in a block, slots that the weights share out, rows that a bucket of ranks holds on average, buckets whose counts are summed in one go.
BLOCK, SLOTS, BUCKET, RUN = 8, 1000, 500, 1000
NO_SOURCE = "\0"


def weights(sizes: dict[str, int], power: float = 0.5, slots: int = SLOTS) -> dict[str, int]:
    """Targets: slots for each source in proportion to its size to the given power; one at least, largest remainders first."""
    if not sizes:
        return {}
    slots = max(slots, len(sizes))
    total = sum(n**power for n in sizes.values())
    due = {s: slots * n**power / total for s, n in sizes.items()}
    out = {s: max(1, int(x)) for s, x in due.items()}
    for s in sorted(due, key=lambda s: (int(due[s]) - due[s], s))[: max(0, slots - sum(out.values()))]:
        out[s] += 1
    return out


def period(m: dict[str, int]) -> Iterator[str]:
    """Earliest deadline first over one period of sum(m) slots in which source s has m[s] blocks. Ties go by name."""
    total = sum(m.values())
    release = lambda s, k: (k - 1) * total // m[s]
    due = lambda s, k: -(-k * total // m[s])
    waiting = [(0, s, 1) for s in sorted(m) if m[s]]
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []
    for t in range(total):
        while waiting and waiting[0][0] <= t:
            _, s, k = heapq.heappop(waiting)
            heapq.heappush(ready, (due(s, k), s, k))
        _, s, k = heapq.heappop(ready)
        yield s
        if k < m[s]:
            heapq.heappush(waiting, (release(s, k + 1), s, k + 1))


def phases(blocks: dict[str, int], m: dict[str, int]) -> Iterator[tuple[str, int, int, int, int, int, int, int]]:
    """(source, phase, weight, period, first slot of the phase, first block, blocks in the phase, place in the period) of each block of a period.

    A phase is over with the block that leaves its source dry. The last field lists the source's places one by one: the
    nth of them is that of the blocks first + nth, first + nth + weight and so on.
    """
    left, slot, number = {s: n for s, n in blocks.items() if n}, 0, 0
    done = dict.fromkeys(left, 0)
    while left:
        own = {s: m[s] for s in left}
        total = sum(own.values())
        turns = min((n - 1) // own[s] for s, n in left.items())  # whole periods after which none is dry
        after = {s: n - turns * own[s] for s, n in left.items()}
        places: dict[str, list[int]] = {s: [] for s in left}
        spent = 0
        # Places up to the slot that leaves a source dry; the whole period if it is repeated before.
        stop = None
        for at, s in enumerate(period(own)):
            places[s].append(at)
            if stop is None and len(places[s]) == after[s]:
                stop = at + 1
                spent = {x: len(p) for x, p in places.items()}
                if not turns:
                    break
        for s, p in places.items():
            n = turns * own[s] + spent[s]
            for at in p:
                yield s, number, own[s], total, slot, done[s], n, at
            left[s] -= n
            done[s] += n
        slot += turns * total + stop
        number += 1
        left = {s: n for s, n in left.items() if n}


def _plan(sizes: DataFrame, target: dict[str, int] | None, block: int) -> DataFrame:
    """The phases' rows for sizes (source, n); one task, which holds the sources' sizes and one period, and streams the rest."""

    def run(batches):
        got: dict[str, int] = {}
        for pdf in batches:
            got.update(zip(pdf["source"], map(int, pdf["n"]), strict=True))
        m = target or weights(got)
        rows, last = [], {}
        for s, p, k, total, slot, lo, n, at in phases({s: -(-n // block) for s, n in got.items()}, {s: max(1, m.get(s, 1)) for s in got}):
            nth = last[s][1] + 1 if s in last and last[s][0] == p else 0
            last[s] = (p, nth)
            rows.append((s, p, k, total, slot, lo, n, nth, at))
            if len(rows) == 50_000:
                yield pd.DataFrame(rows, columns=names)
                rows = []
        yield pd.DataFrame(rows, columns=names)

    names = ["source", "phase", "weight", "period", "slot", "lo", "n", "nth", "at"]
    return sizes.coalesce(1).mapInPandas(run, "source string, phase int, weight long, period long, slot long, lo long, n long, nth long, at long")


def _ranked(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """row, source, rank (from 0, by hash within the source) of every row of docs; source and n of each source.

    Ranks come from counts of hash buckets, summed in two steps, so a source of any size spreads over as many tasks as it needs.
    """
    rows = rowed(docs, F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)).alias("source"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("hash"), F.col("doc_id").cast("long").alias("id"))
    slim = staged(rows.select("source", "hash"), "mix")
    few = max(1, -(-slim.count() // BUCKET))
    bucket = F.pmod(F.shiftright("hash", 16), F.lit(few)).cast("int")
    counts = staged(slim.groupBy("source", bucket.alias("bucket")).count().withColumn("run", F.floor(F.col("bucket") / RUN).cast("int")), "mix-counts")
    upto = lambda *keys: F.coalesce(F.sum("count").over(W.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    runs = counts.groupBy("source", "run").agg(F.sum("count").alias("count")).select("source", "run", upto("source", "run").alias("before"))
    before = counts.select("source", "bucket", "run", upto("source", "run", "bucket").alias("within")).join(runs, ["source", "run"])
    before = staged(before.select("source", "bucket", (F.col("before") + F.col("within")).alias("before")), "mix-offsets")
    place = F.row_number().over(W.partitionBy("source", "bucket").orderBy("hash", "id")) - 1
    ranked = rows.withColumn("bucket", bucket).withColumn("place", place).join(sized(before, 120), ["source", "bucket"])
    sizes = staged(counts.groupBy("source").agg(F.sum("count").alias("n")), "mix-sizes")
    return ranked.select("row", "source", (F.col("before") + F.col("place")).alias("rank")), sizes


def schedule(docs: DataFrame, target: dict[str, int] | None = None, block: int = BLOCK) -> DataFrame:
    """row (all columns of docs, whatever their names), source, rank, block (from 0 in the source), phase, weight, period and slot of every row.

    target: slots of each source in a period; weights() of the sizes if None. Null sources are one source, \\0. Rows that are
    equal in doc_id and text share a rank order that is arbitrary but harmless, as they can't be told apart. An empty table
    gives an empty result. Blocks with equal deadlines take their slots by the names of their sources.
    """
    ranked, sizes = _ranked(docs)
    plan = _plan(sizes, target, block)
    # All blocks, a row each: a period's places, repeated through the phase.
    turn = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1 - F.col("nth")) / F.col("weight")).cast("long")))
    every = plan.filter("nth < n").select("*", turn.alias("turn"))
    block_no = (F.col("lo") + F.col("turn") * F.col("weight") + F.col("nth")).alias("block")
    every = staged(every.select("source", block_no, "phase", "weight", "period", (F.col("slot") + F.col("turn") * F.col("period") + F.col("at")).alias("slot")), "mix-blocks")
    return ranked.withColumn("block", F.floor(F.col("rank") / block).cast("long")).join(sized(every, 160), ["source", "block"])


def mixed(docs: DataFrame) -> DataFrame:
    """All rows of docs, with their own columns, in the order of the schedule."""
    return schedule(docs).orderBy("slot", "rank").select("row.*")


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its slot; null sources are one source."""
    out = schedule(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return out.select("row.doc_id", "row.source", *[F.col(c).alias(f"mix_{c}") for c in ("rank", "block", "phase", "weight", "period", "slot")])
