"""Mixing sources to target weights by Pfair scheduling.

Every source is cut into blocks of ``block_rows`` documents in a keyed random order. With integer shares k of a total
P, block j of a source is released at slot floor(j * P / k) and due by ceil((j + 1) * P / k). In each slot the released
block with the earliest deadline goes next, which meets every deadline, so at every slot each source is less than one
block from its target. The schedule repeats after P slots, so only one period is worked out. When a source has no
block left, a new phase begins with the shares of those that remain; every document gets exactly one place, none is
dropped or repeated.

Unless shares are given, a source's target is in proportion to a power of its size, in whole thousandths of the mixture (``SHARES``).
Sources too small for half a thousandth are scheduled together, as one member with the share of their sum, whose slots they take
in turns; each is then still less than one block from an equal part of it. So the driver's schedule has at most about
``SHARES`` members and as many phases, however many sources there are.

The rank of a document in its source comes from counts by (source, hash range), and so do the slots of its block: no task
sees a whole source, and the documents move once to be ranked and, if sorted, once more.

Defined cases: null sources are one source; repeated rows each get a place; ties of the hash go by doc_id; an empty
table gives an empty one; where shares are given, sources without one get share 1; a null doc_id is a value like any other;
rows of one source that agree in all that ``mix`` hashes (doc_id, and in ``in_order`` the text) are ranked by one task; texts
of any length move as they are; columns of the input may have any names.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 64
RANGE_ROWS = 256
MOST_BITS = 20
SHARES = 1000
NO_SOURCE, POOL = "\0none", "\0pool"
PHASES = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "start", "share", "total")] + [("slots", pa.list_(pa.int32()))]))


def period(shares: dict[str, int]) -> list[str]:
    """The source of each slot of one period."""
    total = sum(shares.values())
    waiting = [(0, -(-total // k), s, 0) for s, k in sorted(shares.items())]  # release, deadline, source, block
    ready: list[tuple[int, str, int]] = []
    heapq.heapify(waiting)
    out = []
    for at in range(total):
        while waiting and waiting[0][0] <= at:
            _, due, source, j = heapq.heappop(waiting)
            heapq.heappush(ready, (due, source, j))
        _, source, j = heapq.heappop(ready)
        out.append(source)
        k, j = shares[source], j + 1
        if j < k:
            heapq.heappush(waiting, (j * total // k, -(-(j + 1) * total // k), source, j))
    return out


@dataclass
class Phase:
    """Slots from ``start`` on: block ``first[s] + i`` of source s is in the i-th of its slots."""

    start: int
    shares: dict[str, int]
    first: dict[str, int]
    slots: dict[str, list[int]]


def phases(blocks: dict[str, int], shares: dict[str, int]) -> list[Phase]:
    """One phase for each set of sources that still have blocks."""
    left, start, first, out = {s: n for s, n in blocks.items() if n}, 0, dict.fromkeys(blocks, 0), []
    while left:
        now = {s: shares.get(s, 1) for s in left}
        slots: dict[str, list[int]] = {s: [] for s in now}
        for at, s in enumerate(period(now)):
            slots[s].append(at)
        total = sum(now.values())
        slot_of = lambda s, i: i // now[s] * total + slots[s][i % now[s]]  # noqa: B023, E731
        end = min(slot_of(s, n - 1) for s, n in left.items()) + 1
        out.append(Phase(start, now, dict(first), slots))
        for s in now:
            used = end // total * now[s] + sum(x < end % total for x in slots[s])
            first[s] += used
            left[s] -= used
        left, start = {s: n for s, n in left.items() if n}, start + end
    return out


def tempered(counts: dict[str, int], power: float = 0.5, total: int = SHARES) -> dict[str, int]:
    """Integer shares in proportion to a power of the sources' sizes, at least 1 each."""
    mass = {s: n**power for s, n in counts.items()}
    return {s: max(1, round(total * m / sum(mass.values()))) for s, m in mass.items()}


@dataclass
class Pool:
    """Sources that take the slots of one member in turns: in turn r all that have more than r blocks, the largest first."""

    blocks: dict[str, int]

    def __post_init__(self) -> None:
        order = sorted(self.blocks, key=lambda s: (-self.blocks[s], s))
        self.place = {s: i for i, s in enumerate(order)}
        # Turns from ``turn`` on begin at the pool's block ``first`` and have ``active`` sources each.
        self.turns: list[tuple[int, int, int]] = []
        turn = first = 0
        for active in range(len(order), 0, -1):
            until = self.blocks[order[active - 1]]
            if until > turn:
                self.turns.append((turn, first, active))
                first += (until - turn) * active
                turn = until
        self.total = first

    def turns_of(self, source: str) -> list[tuple[int, int, int]]:
        return [t for t in self.turns if t[0] < self.blocks[source]]


def pooled(counts: dict[str, int], block_rows: int, power: float, total: int = SHARES) -> tuple[Pool, dict[str, int], dict[str, int]]:
    """(pool, blocks and shares of the members); a pool of fewer than two sources is empty."""
    blocks, mass = {s: -(-n // block_rows) for s, n in counts.items()}, {s: n**power for s, n in counts.items()}
    whole = sum(mass.values())
    small = {s for s, m in mass.items() if total * m / whole < 0.5}
    small = small if len(small) > 1 else set()
    shares = {s: max(1, round(total * m / whole)) for s, m in mass.items() if s not in small}
    pool, members = Pool({s: blocks[s] for s in small}), {s: blocks[s] for s in shares}
    if small:
        shares[POOL], members[POOL] = max(1, round(total * sum(mass[s] for s in small) / whole)), pool.total
    return pool, members, shares


def mix(docs: DataFrame, shares: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS, power: float = 0.5, tie: list[Column] | None = None) -> DataFrame:
    """(row, __source, __block, __slot, __position): each row of ``docs`` as a struct and its place; positions ascend in the order of the mixture.

    ``shares`` are the integer target weights by source; by default those of ``pooled``. The driver holds one count for
    each source, and the shares' sum times the number of members at most as schedule.
    """
    spark = docs.sparkSession
    named = docs.select(F.struct(*docs.columns).alias("row")).withColumns({"__source": F.coalesce(F.col("row.source").cast("string"), F.lit(NO_SOURCE)), "__hash": F.xxhash64("row.doc_id", *(tie or []))})
    counts = {r[0]: r[1] for r in named.groupBy("__source").count().collect()}
    if shares is None:
        pool, blocks, shares = pooled(counts, block_rows, power)
    else:
        pool, blocks = Pool({}), {s: -(-n // block_rows) for s, n in counts.items()}
    plan = phases(blocks, shares)
    of = [[{"first": p.first[m], "start": p.start, "share": p.shares[m], "total": sum(p.shares.values()), "slots": p.slots[m]} for p in plan if m in p.shares] for m in blocks]
    # From Arrow tables, not rows: those start Python workers.
    schedule = spark.createDataFrame(pa.table({"__member": pa.array(list(blocks), pa.string()), "__phases": pa.array(of, PHASES)}))
    names, turns = list(counts), pa.list_(pa.struct([(n, pa.int64()) for n in ("turn", "first", "active")]))
    in_pool = [s in pool.place for s in names]
    members = spark.createDataFrame(pa.table({
        "__source": pa.array(names, pa.string()),
        "__member": pa.array([POOL if p else s for s, p in zip(names, in_pool)], pa.string()),
        "__turns": pa.array([[dict(zip(("turn", "first", "active"), t)) for t in pool.turns_of(s)] if p else None for s, p in zip(names, in_pool)], turns),
        "__place": pa.array([pool.place.get(s, 0) for s in names], pa.int64()),
    }))

    bits = min(MOST_BITS, max(0, math.ceil(math.log2(max([1, *counts.values()]) / RANGE_ROWS))))
    ranged = named.withColumn("__range", F.shiftrightunsigned("__hash", 64 - bits) if bits else F.lit(0).cast("long"))
    # By (source, range): the rank of its first row, and the slots of the blocks that its rows fall in.
    sizes = ranged.groupBy("__source", "__range").agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__source").orderBy("__range")) - F.col("__n")
    spans = sizes.withColumn("__before", before).join(members, "__source").join(schedule, "__member")
    first, last = F.floor(F.col("__before") / F.lit(block_rows)), F.floor((F.col("__before") + F.col("__n") - 1) / F.lit(block_rows))

    def slot(block: Column) -> Column:
        """Of a source's block; the pool's block first, where the source is in it."""
        t = F.element_at(F.filter("__turns", lambda t: t["turn"] <= block), -1)
        block = F.when(F.col("__turns").isNull(), block).otherwise(t["first"] + (block - t["turn"]) * t["active"] + F.col("__place"))
        p = F.element_at(F.filter("__phases", lambda p: p["first"] <= block), -1)
        i = block - p["first"]
        return p["start"] + F.floor(i / p["share"]) * p["total"] + F.element_at(p["slots"], (F.pmod(i, p["share"]) + 1).cast("int"))

    spans = spans.select("__source", "__range", "__before", first.alias("__first"), F.transform(F.sequence(first, last), slot).alias("__slots"))
    inside = F.row_number().over(Window.partitionBy("__source", "__range").orderBy("__hash", "row.doc_id")) - 1
    ranked = ranged.withColumn("__inside", inside).join(spans, ["__source", "__range"]).withColumn("__rank", F.col("__before") + F.col("__inside"))
    placed = ranked.withColumn("__block", F.floor(F.col("__rank") / F.lit(block_rows)))
    placed = placed.withColumn("__slot", F.element_at("__slots", (F.col("__block") - F.col("__first") + 1).cast("int")))
    placed = placed.withColumn("__position", F.col("__slot") * block_rows + F.pmod("__rank", F.lit(block_rows)))
    return placed.select("row", "__source", "__block", "__slot", "__position")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, source, block, slot, position) of every document."""
    of = mix(docs.select("doc_id", "source"), **options)
    return of.select("row.doc_id", "row.source", F.col("__block").alias("block"), F.col("__slot").alias("slot"), F.col("__position").alias("position"))


def in_order(docs: DataFrame, **options) -> DataFrame:
    """The documents with their columns, sorted into the order of the mixture."""
    tie = [F.xxhash64(F.coalesce(F.col("row.text"), F.lit("")))]
    return mix(docs, tie=tie, **options).orderBy("__position").select("row.*")
