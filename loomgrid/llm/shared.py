"""What several operators of this subpackage need: shared scratch tables, model samples, tiles of rows and connected components.

Scratch tables are written below ``spark.checkpoint.dir``: every executor sees them, and a lost executor only
costs the tasks it was running. Nothing here uses a machine-local folder on a cluster. Tables that a lazy result still reads
stay until the owner of that folder clears it.
"""

from __future__ import annotations

import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

DIR_KEY, MASTER_KEY = "spark.checkpoint.dir", "spark.master"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names. Where none is named, one process (``local``) has a folder of its own; on
    a cluster that is an error, since a folder of one machine would lose rows."""
    base = spark.conf.get(DIR_KEY, None)
    if not base and spark.conf.get(MASTER_KEY, "local").split("[")[0] != "local":
        raise ValueError(f"set {DIR_KEY} to a folder that the driver and all executors share")
    base = base or kept("scratch", lambda: tempfile.mkdtemp(prefix="loomgrid-"))
    path = f"{base.rstrip('/')}/loomgrid/{name}-{uuid.uuid4().hex}"
    kept("made", list).append(path)
    return path


def materialize(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write ``df`` once and read it back: cuts lineage, and later jobs don't repeat the work."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete scratch tables that no lazy result reads any more."""
    for df in tables:
        for d in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/loomgrid/" in f}:
            delete(df.sparkSession, d)


@contextmanager
def swept(spark: SparkSession, keep: list[str]) -> Iterator[None]:
    """Delete all scratch tables that are made inside but those below the paths of ``keep``, which may be added to meanwhile."""
    made = kept("made", list)
    before = len(made)
    try:
        yield
    finally:
        for path in made[before:]:
            if path not in keep:
                delete(spark, path)
        del made[before:]


BATCH_KEY, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """Rows go to Python in batches of at most 8 MB (a setting of the session, lowered only): what a task holds outside the
    heap then doesn't grow with the length of texts."""
    conf = df.sparkSession.conf
    now = conf.get(BATCH_KEY, None)
    if now is not None and (not now.rstrip("b").isdigit() or int(now.rstrip("b")) > BATCH_BYTES):
        conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def slot(key: str, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo: the folds of the query contracts."""
    return F.pmod(F.crc32(F.col(key).cast("string")), F.lit(modulus))


def chunked(values: list, size: int) -> Iterator[list]:
    for i in range(0, len(values), size):
        yield values[i : i + size]


def kept(key: str, make: Callable):
    """One object for each Python worker process, made once and kept between its tasks."""
    store = sys.modules.setdefault("_loomgrid_kept", types.ModuleType("_loomgrid_kept")).__dict__
    if key not in store:
        store[key] = make()
    return store[key]


# ---------------------------------------------------------------- tiles


def tile_pairs(rows: DataFrame, cell: list[str], item: str, offsets: list[tuple[int, ...]], tile_rows: int, grid: list[str], carry: str | None = None) -> DataFrame:
    """Pairs of tiles whose cells differ by one of ``offsets`` in the ``grid`` columns: (left, right, same[, carry]).

    ``rows`` has integer ``cell`` columns (``grid`` are those that neighbours may differ in) and an ``item`` to pack.
    ``offsets`` hold one of each offset and its negative, and zero, so that each pair of rows meets exactly once.
    A cell of many rows is split into tiles of about ``tile_rows``, so no task ever holds a whole hot cell. The
    number of cells is bounded by the grid's geometry, not by the data, so their counts are broadcast.
    """
    counts = rows.groupBy(*cell).agg(F.ceil(F.count("*") / F.lit(tile_rows)).cast("int").alias("_chunks"))
    dealt = rows.join(F.broadcast(counts), cell).withColumn("_chunk", F.pmod(F.xxhash64(item), F.col("_chunks")).cast("int"))
    tiles = materialize(dealt.groupBy(*cell, "_chunk").agg(F.collect_list(item).alias("_items")), "tiles")
    steps = F.explode(F.array(*[F.struct(*[F.lit(o).alias(g) for g, o in zip(grid, off)]) for off in offsets]))
    left = tiles.select(*cell, F.col("_chunk").alias("_lchunk"), F.col("_items").alias("left"), steps.alias("_step"))
    zero = F.lit(True)
    for g in grid:
        zero = zero & (F.col(f"_step.{g}") == 0)
    left = left.select(*[(F.col(c) + F.col(f"_step.{c}") if c in grid else F.col(c)).alias(c) for c in cell], "_lchunk", "left", zero.alias("_same_cell"))
    both = left.join(tiles.select(*cell, "_chunk", F.col("_items").alias("right")), cell)
    both = both.where(~F.col("_same_cell") | (F.col("_lchunk") <= F.col("_chunk")))
    return both.select("left", "right", (F.col("_same_cell") & (F.col("_lchunk") == F.col("_chunk"))).alias("same"), *[carry] * bool(carry))


# ---------------------------------------------------------------- runs of rows, hot keys


def consecutive(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple[int, ...], pa.Table]]:
    """Runs of rows that agree in the first ``keys`` columns (integers), of a sorted partition; one run is held at a time."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        changes = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *changes.tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            key = tuple(int(c[a]) for c in columns)
            if key != last and held:
                yield last, pa.Table.from_batches(held)
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held)


HOT_ROWS, HOT_SHARE = 4096, 10_000


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """``left`` with what ``right`` (one row a key) says of its key; ``how`` is inner or left.

    Keys that hold over ``HOT_ROWS`` rows of ``left`` and over 1 / ``HOT_SHARE`` of them, so less than ``HOT_SHARE`` keys, are joined
    where they are read, from a broadcast of their rows of ``right``; all others are dealt by key. ``left`` is read several
    times and so should be a written table.
    """
    least = max(HOT_ROWS, left.count() // HOT_SHARE)
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > least).select(key)
    keys = [tuple(r) for r in hot.collect()]  # less than HOT_SHARE
    if not keys:
        return left.join(right, key, how)
    hot = left.sparkSession.createDataFrame(pa.table({key: pa.array([k[0] for k in keys], pa.int64())}))
    near = left.join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, "inner")
    if how == "left":  # a hot key that right doesn't have
        near = left.join(F.broadcast(hot), key, "left_semi").join(F.broadcast(right.join(F.broadcast(hot), key, "left_semi")), key, "left")
    far = left.join(F.broadcast(hot), key, "left_anti").join(right, key, how)
    return near.unionByName(far)


# ---------------------------------------------------------------- connected components


class Forest:
    """Union-find with the smallest member as root; holds only nodes that have a link."""

    def __init__(self) -> None:
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        up = self.up
        root = up.setdefault(x, x)
        while up[root] != root:
            root = up[root]
        while up[x] != root:
            up[x], x = root, up[x]
        return root

    def link(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def link_all(self, a: np.ndarray, b: np.ndarray) -> None:
        """Many links at once: numpy finds the classes among them, and only one link for each node is added."""
        if len(a) < 64:
            for x, y in zip(a.tolist(), b.tolist()):
                self.link(x, y)
            return
        nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        i, j = at[: len(a)], at[len(a) :]
        root = np.arange(len(nodes))
        while True:
            low = np.minimum(root[i], root[j])
            before = root.copy()
            np.minimum.at(root, root[i], low)
            np.minimum.at(root, root[j], low)
            while (deeper := root[root] != root).any():
                root[deeper] = root[root[deeper]]
            if (root == before).all():
                break
        for x, y in zip(nodes.tolist(), nodes[root].tolist()):
            self.link(x, y)

    def batch(self) -> pa.RecordBatch:
        """One edge (node, root) for each node that isn't a root: at most as many as nodes."""
        nodes = [x for x in self.up if self.find(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([self.find(x) for x in nodes], pa.int64())], names=["a", "b"])


def spanning(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one partition, reduced to a spanning forest of them."""
    forest = Forest()
    for batch in batches:
        forest.link_all(batch.column(0).to_numpy(), batch.column(1).to_numpy())
    yield forest.batch()


LAST_LINKS = 1 << 16


def components(links: DataFrame, reduced: bool = False, last_links: int = LAST_LINKS) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b longs); component is the smallest node reachable. A written table.

    Each round hooks every node to the smallest, in the order of a hash, of itself and its neighbours, and contracts the links:
    in such an order about half of the nodes go in a round, whatever the shape (chains, stars), so rounds are logarithmically
    many. Partitions reduce their links to spanning forests before each exchange. Once no more than ``last_links``, a constant,
    are left, one task finishes. Links from a node to itself are ignored; no links give an empty table. ``reduced`` links come from
    tasks that span them already: two Python steps in one task would hold twice as many workers.
    """
    reduce = lambda df: small_batches(df).mapInArrow(spanning, "a long, b long")
    given = links.select("a", "b").where("a <> b")
    given = materialize(given if reduced else reduce(given), "links")
    left = given.count()
    if left <= last_links:
        out = materialize(labelled(given), "components")
        discard(given)
        return out
    # The hash of one long is a permutation of the longs: hashed nodes stand for nodes until the end.
    current, hooks = given.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b")), []
    while left > last_links:
        ways = current.union(current.select("b", "a")).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near"))
        hook = materialize(ways.select("node", F.least("node", "near").alias("up")), "hooks")
        hooks.append(hook)
        step = join_hot(current, hook.toDF("a", "ua"), "a").select("b", "ua")
        step = materialize(step, "half")
        moved = join_hot(step, hook.toDF("b", "ub"), "b").where("ua <> ub").select(F.col("ua").alias("a"), F.col("ub").alias("b"))
        after = materialize(reduce(moved), "links")
        discard(step, *([current] if len(hooks) > 1 else []))
        current, left = after, after.count()
    label = materialize(labelled(current).toDF("node", "root"), "roots")
    for hook in reversed(hooks):
        above = label
        label = materialize(join_hot(hook, above.toDF("up", "root"), "up", "left").select("node", F.coalesce("root", "up").alias("root")), "roots")
        discard(above, hook)
    discard(current)
    nodes = given.select(F.col("a").alias("id")).union(given.select("b")).distinct().select("id", F.xxhash64("id").alias("node"))
    rooted = materialize(nodes.join(label, "node").select("id", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("id").alias("component"))
    out = materialize(join_hot(rooted, least, "root").select(F.col("id").alias("node"), "component"), "components")
    discard(label, given, rooted)
    return out


def labelled(links: DataFrame) -> DataFrame:
    """(node, component) of so few links that one task can hold them."""

    def run(batches):
        forest = Forest()
        for batch in batches:
            forest.link_all(batch.column(0).to_numpy(), batch.column(1).to_numpy())
        nodes = list(forest.up)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([forest.find(x) for x in nodes], pa.int64())], names=["node", "component"])

    return links.coalesce(1).mapInArrow(run, "node long, component long")
