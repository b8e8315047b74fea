"""Embedding near-dedup by a subspace pigeonhole join.

Unit vectors of cosine >= t are at most d = 2 - 2t apart (squared). They are rotated by a fixed orthogonal matrix and
split into blocks of few dimensions; of two vectors that close, at least one block is within its share of d in
proportion to its dimensions. So each block is range-joined: a grid over its leading dimensions has cells twice as wide as
the block's radius; a vector lies in its own cell and, where it is within the radius of an upper border, in the next one
too, so two near ones meet in just one cell. Cells of many rows are cut into tiles that meet in pairs. Block distances
within the budget make candidates; of the union of candidates each pair is verified once, in the first block that has it, by
the cosine of the given vectors in double precision. Tasks return counts of links and spanning forests, never pairs.

Equal vectors are one row before anything is compared, and count as often as they came. Vectors of each length are compared
among themselves.

Defined cases: vectors that are null, zero, or hold null or non-finite components link with nothing; vectors of different
lengths don't link; repeated rows are separate vectors; a vec_id that comes with several vectors stands in each of their
classes, and null ids in theirs; of ties the smallest vec_id is kept; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.shared import Forest, components, consecutive, discard, join_hot, kept, materialize, small_batches

THRESHOLD = 0.95
BLOCK_DIMS = 16
GRID_DIMS = 2
TILE_ROWS = 16_384
BROADCAST_ROWS = 1_000_000
SLACK = 1e-9


def rotation(dims: int, seed: int = 11) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, dims)))
    return q * np.sign(np.diag(r))


def bounds(dims: int, block_dims: int) -> list[tuple[int, int]]:
    return [(a, min(a + block_dims, dims)) for a in range(0, dims, block_dims)]


def scaled(x: np.ndarray) -> np.ndarray:
    """So that squares neither overflow nor vanish."""
    return x / np.abs(x).max(1, keepdims=True, initial=0)


def units(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vector_of(embedding: str = "embedding") -> Column:
    """The vector in doubles; null where it can link with nothing."""
    v = F.col(embedding).cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return F.when(v.isNotNull() & sound, v)


def classes(vectors: DataFrame) -> DataFrame:
    """(class_id, h, i, first, copies, vector): the distinct vectors that can link, by 128 bits of hashes."""
    given = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), vector_of().alias("vector")).where("vector is not null")
    keyed = given.select("*", F.xxhash64("vector").alias("h"), F.xxhash64(F.lit(1), "vector").alias("i"))
    alike = keyed.groupBy("h", "i").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    return alike.select(F.monotonically_increasing_id().alias("class_id"), "h", "i", "first", "copies", "vector")


class Space:
    """What all vectors of one length share: the rotation, the blocks and their budgets, and the grid."""

    def __init__(self, dims: int, threshold: float, block_dims: int, grid_dims: int, kind: str) -> None:
        self.turn, self.spans, most = rotation(dims), bounds(dims, block_dims), 2 - 2 * threshold
        self.budget = np.array([most * (b - a) / dims for a, b in self.spans]) + SLACK
        self.item = np.dtype([("id", "<i8"), ("copies", "<i8"), ("x", kind, (dims,))])
        self.radius = np.sqrt(self.budget) + SLACK
        self.cells = np.ceil(1 / self.radius).astype(np.int64) + 2  # in a dimension, over -1 to 1 and the next ones
        self.grid = [min(grid_dims, b - a, int(62 // np.log2(2 * c))) for (a, b), c in zip(self.spans, self.cells)]

    def places(self, y: np.ndarray, k: int):
        """(cell, mask, rows) of the k-th block: the cells that rows lie in, and the dimensions in which that isn't their own one."""
        a, g, wide = self.spans[k][0], self.grid[k], 2 * self.radius[k]
        at = np.floor(y[:, a : a + g] / wide).astype(np.int64)
        border = (at + 1) * wide - y[:, a : a + g] <= self.radius[k]
        for mask in range(1 << g):
            on = np.array([mask >> i & 1 for i in range(g)], bool)
            rows = np.flatnonzero(border[:, on].all(1))
            cell = np.zeros(len(rows), np.int64)
            for i in range(g):
                cell = cell * 2 * self.cells[k] + at[rows, i] + on[i] + self.cells[k]
            yield cell, mask, rows


def near(distinct: DataFrame, threshold: float, block_dims: int, grid_dims: int, tile_rows: int, kind: str) -> DataFrame:
    """(a, b, n): spanning links between classes, and for each class (b null) how many vectors a task linked it to."""
    spark = distinct.sparkSession
    space = lambda dims: kept(f"space {dims} {threshold} {block_dims} {grid_dims} {kind}", lambda: Space(dims, threshold, block_dims, grid_dims, kind))
    names = ["dims", "block", "cell", "mask", "item"]

    def cells(batches):
        for batch in batches:
            lengths = np.asarray(batch.column(2).value_lengths())
            for dims in np.unique(lengths).tolist():
                part = batch.filter(pa.array(lengths == dims))
                s, x = space(dims), part.column(2).flatten().to_numpy().reshape(-1, dims)
                y, packed = units(x) @ s.turn, np.empty(len(x), s.item)
                packed["id"], packed["copies"], packed["x"] = part.column(0).to_numpy(), part.column(1).to_numpy(), x
                blobs = pa.array([row.tobytes() for row in packed], pa.binary())
                for k in range(len(s.spans)):
                    for cell, mask, rows in s.places(y, k):
                        n = len(rows)
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, dims, np.int32)), pa.array(np.full(n, k, np.int32)), pa.array(cell), pa.array(np.full(n, mask, np.int32)), blobs.take(pa.array(rows))], names=names)

    rows = materialize(small_batches(distinct.select("class_id", "copies", "vector")).mapInArrow(cells, "dims int, block int, cell long, mask int, item binary"), "cells")
    # Only cells of more rows than a tile are cut; there are fewer of them than rows / tile_rows, and no more than the grid has.
    full = rows.groupBy("dims", "block", "cell").agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("chunks")).where("chunks > 1")
    full = materialize(full, "full")
    dealt = rows.join(F.broadcast(full) if full.count() <= BROADCAST_ROWS else full, ["dims", "block", "cell"], "left")
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("item"), chunks).cast("int")
    paired = dealt.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    keys = ["dims", "block", "cell", "a", "b"]
    keyed = paired.select("dims", "block", "cell", F.least("own", "other").alias("a"), F.greatest("own", "other").alias("b"), (F.col("own") > F.col("other")).cast("int").alias("side"), "mask", "item")
    tiles = keyed.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).sortWithinPartitions(*keys, "side")

    def compare(batches):
        forest, left, at = Forest(), None, None
        for (dims, k, cell, a, b, side), table in consecutive(batches, 6):
            s = space(dims)
            raw = np.frombuffer(b"".join(table["item"].to_pylist()), s.item)
            x = raw["x"].astype(float)
            tile = (raw["id"], raw["copies"], x, units(x) @ s.turn, table["mask"].to_numpy())
            if a == b:
                yield from matched(forest, s, k, tile, tile)
            elif side == 0:
                left, at = tile, (dims, k, cell, a, b)
            elif at == (dims, k, cell, a, b):
                yield from matched(forest, s, k, left, tile)
        tree = forest.batch()
        yield pa.RecordBatch.from_arrays([tree.column(0), tree.column(1), pa.nulls(tree.num_rows, pa.int64())], names=["a", "b", "n"])

    def matched(forest, s, k, left, right):
        (li, lc, lx, ly, lm), (ri, rc, rx, ry, rm), (a, b) = left, right, s.spans[k]
        same, starts = left is right, [c for c, _ in s.spans]
        p, q = np.ascontiguousarray(ly[:, a:b], np.float32), np.ascontiguousarray(ry[:, a:b], np.float32)
        pp, qq = (p * p).sum(1), (q * q).sum(1)
        linked = [np.zeros(len(li), np.int64), np.zeros(len(ri), np.int64)]
        for u in range(0, len(p), 128):
            first = u if same else 0
            gap = p[u : u + 128] @ q[first:].T
            gap *= -2
            gap += pp[u : u + 128, None]
            gap += qq[first:]
            i, j = np.divmod(np.flatnonzero(gap <= s.budget[k] + 1e-5), gap.shape[1])
            i, j = i + u, j + first
            # Both are in this cell; it is theirs to meet in if no dimension moved both.
            ok = (lm[i] & rm[j]) == 0
            ok &= (i < j) if same else True
            i, j = i[ok], j[ok]
            for t in range(0, len(i), 65536):
                x, y = i[t : t + 65536], j[t : t + 65536]
                gaps = np.add.reduceat((ly[x] - ry[y]) ** 2, starts, axis=1)
                now = (gaps[:, k] <= s.budget[k]) & ((gaps <= s.budget).argmax(1) == k)  # only the first block that has a pair verifies it
                x, y = x[now], y[now]
                v, w = scaled(lx[x]), scaled(rx[y])
                cosine = (v * w).sum(1) / np.sqrt((v * v).sum(1) * (w * w).sum(1))
                x, y = x[cosine >= threshold], y[cosine >= threshold]
                forest.link_all(li[x], ri[y])
                linked[0] += np.bincount(x, rc[y], len(li)).astype(np.int64)
                linked[1] += np.bincount(y, lc[x], len(ri)).astype(np.int64)
        for ids, n in zip((li, ri), linked):
            yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.nulls(int((n > 0).sum()), pa.int64()), pa.array(n[n > 0])], names=["a", "b", "n"])

    found = materialize(small_batches(tiles).mapInArrow(compare, "a long, b long, n long"), "found")
    discard(rows, full)
    return found


def vector_components(vectors: DataFrame, threshold: float = THRESHOLD, block_dims: int = BLOCK_DIMS, grid_dims: int = GRID_DIMS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector."""
    distinct = materialize(classes(vectors), "classes")
    kind = "<f4" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "<f8"
    found = near(distinct, threshold, block_dims, grid_dims, tile_rows, kind)
    root = components(found.where("b is not null").select("a", "b"), reduced=True).toDF("class_id", "root")
    others = found.where("b is null").groupBy(F.col("a").alias("class_id")).agg(F.sum("n").alias("others"))
    of = distinct.select("class_id", "h", "i", "first", "copies").join(root, "class_id", "left").join(others, "class_id", "left")
    of = materialize(of.select("h", "i", "first", F.coalesce("root", "class_id").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links")), "classes")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    label = materialize(join_hot(of, least, "root").select("h", F.col("i").alias("_i"), "n_links", "component_id"), "labels")
    v = vector_of()
    given = materialize(vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.when(v.isNotNull(), F.xxhash64(v)).alias("h"), F.xxhash64(F.lit(1), v).alias("i")), "given")
    discard(distinct, found, of)
    sound = join_hot(given.where("h is not null"), label, "h").where("i = _i").select("vec_id", "n_links", "component_id")
    out = sound.union(given.where("h is null").select("vec_id", F.lit(0).cast("long"), "vec_id"))
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
