"""SimHash near-duplicates by tiled exact comparison.

``simhash_components`` links documents whose 64-bit fingerprints (``fingerprints``, over three-word shingles) differ in at most
three bits. Equal fingerprints are one row before anything is compared. The distinct ones are dealt into cells by the
population counts of their four 16-bit lanes: two fingerprints within the radius differ by at most the radius in the sum of
the lanes' counts, so only such tile pairs meet and all others are skipped; those that meet are compared exactly, with numpy's
exclusive or and bit counts. A comparing task returns a spanning forest of its links, never all pairs of a group, and
no link between different texts is lost.

``near_components`` links texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, which three bits don't
tell: it compares fingerprints of 256 bits of the sets in the same way, with a radius that holds all but a few in 100 000 of such
pairs; then parity sketches, whose differing bits are no more than the shingles that only one set has (and in large sets,
where bits meet, as many as expected of them); and verifies what is left by the sets themselves, so a link is never a guess. Tiles hold texts of about one size, and only
those meet whose sizes allow the similarity; within them, rows whose population counts differ beyond the radius are skipped.
Pairs to verify are chosen in rounds, so that a group of copies costs about one a text: each text with the candidate that has most
near ones itself, then with the nearest one of another class, and at last every candidate pair that still lies in two classes.

Both compare a number of pairs that grows with the square of the distinct texts, as any tiled comparison does; the filters only make
it a small part of them.

Defined cases: null text is an empty text; no words give fingerprint zero, linked like any other, and are near copies of each
other; an empty table gives an empty one; repeated rows are returned as often as they come in; null doc_ids come after all
others, and a class of null doc_ids alone has component null; very long texts count whole; of ties the smallest doc_id stays;
other columns are ignored. ``keep_one`` takes rows of equal doc_id as one document: they stay or go together, and of those with
equal text one stays.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.shared import Forest, components, consecutive, discard, join_hot, materialize, small_batches, tile_pairs

RADIUS = 3
WORDS = 3
LANES = 4
TILE_ROWS = 2048
BYTES = np.uint64(0x0101010101010101)


def majority(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The fingerprint of each run of hashes (none empty): a bit is 1 if set in over half of the run.

    Bits are summed eight at a time, as the bytes of a word, in stretches of at most 255 hashes.
    """
    if not len(sizes):
        return np.empty(0, np.uint64)
    starts, parts = np.cumsum(sizes) - sizes, -(-sizes // 255)
    before = np.cumsum(parts) - parts
    cut = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(before, parts))
    ones = np.empty((len(sizes), 8, 8), np.int64)
    for k in range(8):
        sums = np.add.reduceat((hashes >> np.uint64(k)) & BYTES, cut).astype("<u8").view(np.uint8).reshape(-1, 8)
        ones[:, :, k] = np.add.reduceat(sums.astype(np.int64), before, axis=0)
    return np.packbits((2 * ones > sizes[:, None, None]).reshape(len(sizes), 64), axis=1, bitorder="little").view("<u8").ravel()


def fingerprints_of(texts: list[str | None], words: int = WORDS) -> np.ndarray:
    """A-Z lower-cased; words are runs of other bytes than ASCII white space; a bit is set if over half of the
    shingles' XXH64 (seed 42) have it, repeats included."""
    hashes, sizes = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        tokens = (text or "").encode().lower().split()  # of bytes: only ASCII letters and ASCII white space
        if tokens:
            shingles = map(b" ".join, zip(*[tokens[k:] for k in range(words)])) if len(tokens) >= words else [b" ".join(tokens)]
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, shingles, itertools.repeat(42)), np.uint64))
            sizes[i] = len(hashes[-1])
    out = np.zeros(len(texts), np.uint64)
    if hashes:
        out[sizes > 0] = majority(np.concatenate(hashes), sizes[sizes > 0])
    return out


def fingerprint(text: str, words: int = WORDS) -> int:
    return int(fingerprints_of([text], words)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, fp): the 64-bit fingerprint of each whole text as a signed long."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                ids, texts = batch.slice(i, 128).columns
                yield pa.RecordBatch.from_arrays([ids, pa.array(fingerprints_of(texts.to_pylist(), words).view(np.int64))], names=["doc_id", "fp"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def links(distinct: DataFrame, radius: int = RADIUS, lanes: int = LANES) -> DataFrame:
    """(a, b): links that span what lies within ``radius`` bits, over a table of distinct ``fp``."""
    width = 64 // lanes
    grid = [f"c{i}" for i in range(lanes)]
    near = [o for o in itertools.product(range(-radius, radius + 1), repeat=lanes) if sum(map(abs, o)) <= radius and o >= (0,) * lanes]
    lane = [F.bit_count(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))).cast("int").alias(g) for g, mask in zip(grid, [((1 << width) - 1) << (i * width) for i in range(lanes)])]
    pairs = tile_pairs(distinct.select("fp", *lane), grid, "fp", near, TILE_ROWS, grid)

    def compare(batches):
        forest = Forest()
        for batch in batches:
            left, right, same = batch.columns
            lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
            lv, rv = left.values.to_numpy().view(np.uint64), right.values.to_numpy().view(np.uint64)
            for i, is_same in enumerate(same.to_pylist()):
                a, b = lv[lo[i] : lo[i + 1]], rv[ro[i] : ro[i + 1]]
                for j in range(0, len(a), 512):
                    x, y = np.nonzero(np.bitwise_count(a[j : j + 512, None] ^ b[None, :]) <= radius)
                    if is_same:
                        x, y = x[j + x < y], y[j + x < y]
                    forest.link_all(a[j + x].view(np.int64), b[y].view(np.int64))
        yield forest.batch()

    return small_batches(pairs).mapInArrow(compare, "a long, b long")


def simhash_components(docs: DataFrame, radius: int = RADIUS, words: int = WORDS, lanes: int = LANES) -> DataFrame:
    """(doc_id, fingerprint, component_id): the class of each document, the smallest doc_id reachable by links."""
    prints = materialize(fingerprints(docs, words), "fingerprints")
    distinct = materialize(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    found = components(links(distinct, radius, lanes), reduced=True).toDF("fp", "root")
    rooted = materialize(distinct.join(found, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "rooted")
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    label = materialize(join_hot(rooted, smallest, "root").select("fp", "component_id"), "labels")
    discard(distinct, found, rooted)
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return join_hot(prints, label, "fp").select("doc_id", hexed, "component_id")


# ---------------------------------------------------------------- near copies by wide fingerprints of sets

SET_WORDS = 5
LEAST = (4, 5)
PLANES = 4
PARITY = 16
SPREAD = 4.5
SIMILAR_TILE_ROWS = 16_384
STEP = 1.01
PAIRS = 1024
BROADCAST_ROWS = 200_000
MIX = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def shingle_sets(texts: list[str | None], words: int = SET_WORDS) -> list[np.ndarray]:
    """The distinct shingles of each text as ascending 64-bit hashes; fewer words than a shingle are one; no words, none."""
    factors = [np.uint64(pow(MIX[0], k + 1, 1 << 64)) for k in range(words)]
    out = []
    for text in texts:
        tokens = (text or "").encode().lower().split()
        u = np.fromiter(map(xxhash.xxh64_intdigest, tokens, itertools.repeat(42)), np.uint64, len(tokens))
        if 0 < len(u) < words:
            u = np.concatenate([u, np.full(words - len(u), len(u), np.uint64)])
        h = np.zeros(max(0, len(u) - words + 1), np.uint64)
        for k, f in enumerate(factors):
            h += u[k : k + len(h)] * f
        h ^= h >> np.uint64(31)
        h = np.sort(h * np.uint64(MIX[1]))
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h)
    return out


def plane(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of several independent 64-bit hashes."""
    h = hashes + np.uint64((k + 1) * MIX[0] % (1 << 64))
    h = (h ^ (h >> np.uint64(30))) * np.uint64(MIX[1])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(MIX[2])
    return h ^ (h >> np.uint64(31))


def radius_of(bits: int, least: tuple[int, int] = LEAST) -> int:
    """Bits that fingerprints of sets of the least similarity differ by at most, but for a few pairs in 100 000.

    Of such sets a bit differs with a chance of arccos(2 t / (1 + t)) / pi, and by up to 0.01 more in small sets.
    """
    t = least[0] / least[1]
    p = math.acos(2 * t / (1 + t)) / math.pi + 0.01
    return math.floor(bits * p + SPREAD * math.sqrt(bits * p * (1 - p)))


def parity(hashes: np.ndarray, of: np.ndarray, sets: int, words: int = PARITY) -> np.ndarray:
    """A sketch of each set in 64 ``words`` bits (words x sets): a bit says whether an odd number of its hashes fell on it.

    Bits in which two sketches differ are at most as many as the elements that one of the sets has and the other hasn't.
    """
    at = (hashes >> np.uint64(64 - (64 * words - 1).bit_length())).astype(np.int64)
    odd = np.bincount(of * 64 * words + at, minlength=sets * 64 * words) & 1
    return np.packbits(odd.astype(np.uint8).reshape(sets, 64 * words), axis=1, bitorder="little").view("<u8").T


def parity_limits(most: int, least: tuple[int, int], words: int = PARITY) -> np.ndarray:
    """By the sum of two sizes, the differing bits of sketches that sets of the least similarity have at most: the elements in
    which they differ, or, in all but a few cases of 100 000, what is expected of so many."""
    differ = np.arange(most + 1) * (least[1] - least[0]) // (least[1] + least[0])
    bits = 64 * words
    expected = bits / 2 * (1 - np.exp(-2 * differ / bits))
    return np.minimum(differ, np.floor(expected + SPREAD * np.sqrt(bits) / 2)).astype(np.int64)


def set_prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, alike, node, size, f0 .., o0 ..): of each whole text its set's hash, size, fingerprint and parity sketch."""
    prints = [*FINGERPRINT, *SKETCH]

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                ids, alike, texts = batch.slice(i, 128).columns
                sets = shingle_sets(texts.to_pylist(), words)
                sizes = np.array([len(s) for s in sets])
                node = np.fromiter((xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets), np.uint64, len(sets))
                whole, of = np.concatenate(sets), np.zeros((PLANES, len(sets)), np.uint64)
                for k in range(PLANES):
                    of[k, sizes > 0] = majority(plane(whole, k), sizes[sizes > 0])
                odd = parity(plane(whole, PLANES), np.repeat(np.arange(len(sets)), sizes), len(sets))
                yield pa.RecordBatch.from_arrays([ids, alike, pa.array(node.view(np.int64)), pa.array(sizes, pa.int32()), *[pa.array(np.ascontiguousarray(f).view(np.int64)) for f in [*of, *odd]]], names=["doc_id", "alike", "node", "size", *prints])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("alike"), "text")
    return small_batches(given).mapInArrow(run, "doc_id long, alike long, node long, size int, " + ", ".join(f"{f} long" for f in prints))


FINGERPRINT, SKETCH = [f"f{k}" for k in range(PLANES)], [f"o{k}" for k in range(PARITY)]


@dataclass
class Tile:
    """Rows in the order of the first plane's population count; ``more`` has other columns by name."""

    node: np.ndarray
    size: np.ndarray
    planes: list[np.ndarray]
    sketch: np.ndarray
    count: np.ndarray
    more: dict[str, np.ndarray]

    @classmethod
    def of(cls, rows: pa.Table, more: list[str]) -> Tile:
        first = np.bitwise_count(rows["f0"].to_numpy().view(np.uint64))
        by = np.argsort(first, kind="stable")
        take = lambda name: rows[name].to_numpy()[by]
        sketch = [take(name).view(np.uint64) for name in SKETCH if name in rows.column_names]
        return cls(take("node"), take("size").astype(np.int64), [take(f).view(np.uint64) for f in FINGERPRINT], np.column_stack(sketch) if sketch else np.empty((len(by), 0), np.uint64), first[by].astype(np.int64), {m: take(m) for m in more})


def candidates(a: Tile, b: Tile, least: tuple[int, int]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows of a, rows of b, differing bits of the sketches, or of the fingerprints where tiles have none) of pairs within all
    bounds, whose sizes allow the similarity; each pair once."""
    same, near = a is b, radius_of(64, least)
    limits = parity_limits(int(a.size.max() + b.size.max()), least) if a.sketch.shape[1] else None
    for s in range(0, len(a.node), 128):
        x = a.planes[0][s : s + 128]
        low = np.searchsorted(b.count, a.count[s] - near)
        high = np.searchsorted(b.count, a.count[s + len(x) - 1] + near, "right")
        for t in range(max(low, s) if same else low, high, 2048):
            y = b.planes[0][t : min(t + 2048, high)]
            i, j = np.divmod(np.flatnonzero(np.bitwise_count(x[:, None] ^ y[None, :]) <= near), len(y))
            i, j = i + s, j + t
            ok = np.minimum(a.size[i], b.size[j]) * least[1] >= np.maximum(a.size[i], b.size[j]) * least[0]
            if same:
                ok &= i < j
            i, j = i[ok], j[ok]
            bits = np.zeros(len(i), np.int64)
            for p, q in zip(a.planes, b.planes):
                bits += np.bitwise_count(p[i] ^ q[j])
            ok = bits <= radius_of(64 * PLANES, least)
            i, j, bits = i[ok], j[ok], bits[ok]
            if limits is not None:
                bits = np.concatenate([np.bitwise_count(a.sketch[i[k : k + 65536]] ^ b.sketch[j[k : k + 65536]]).sum(1, dtype=np.int64) for k in range(0, len(i), 65536)] or [bits])
                ok = bits <= limits[a.size[i] + b.size[j]]
                i, j, bits = i[ok], j[ok], bits[ok]
            if len(i):
                yield i, j, bits


def tile_plan(sizes: list[tuple[int, int, int, int]], tile_rows: int, least: tuple[int, int]) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """From (class, rows, smallest, largest size) of each class of sizes: (class, first tile, tiles, first and last partner tile), and the
    number of tile pairs. Small classes share a tile, large ones are cut; tiles are partners if their sizes allow the similarity."""
    tiles: list[tuple[int, int]] = []
    of, room = [], 0
    for c, n, low, high in sorted(sizes):
        if tiles and n <= room:
            tiles[-1] = (tiles[-1][0], high)
            room -= n
            of.append((c, len(tiles) - 1, 1))
        else:
            chunks = -(-n // tile_rows)
            of.append((c, len(tiles), chunks))
            tiles += [(low, high)] * chunks
            room = tile_rows - n if chunks == 1 else 0
    lows, highs = [t[0] for t in tiles], [t[1] for t in tiles]
    first, last, u = [], [], 0
    for t in range(len(tiles)):
        while highs[u] * least[1] < lows[t] * least[0]:
            u += 1
        first.append(u)
    u = 0
    for t in range(len(tiles)):
        u = max(u, t)
        while u + 1 < len(tiles) and highs[t] * least[1] >= lows[u + 1] * least[0]:
            u += 1
        last.append(u)
    return [(c, t, k, first[t], last[t]) for c, t, k in of], sum(e - t + 1 for t, e in enumerate(last))


def over_tiles(rows: DataFrame, more: list[str], visit: Callable[[Tile, Tile], Iterator[pa.RecordBatch]], schema: str, least: tuple[int, int], tile_rows: int) -> DataFrame:
    """What ``visit`` yields for every pair of tiles of ``rows`` (node, size, f0 .., maybe o0 .., more) that can hold similar sets.

    The driver plans from the number of rows of each class of sizes, 1 % apart: some thousand numbers at most. Rows go to each of the
    pairs of their tile; tile pairs are dealt by key, and a task holds one pair at a time.
    """
    spark, columns = rows.sparkSession, ["node", "size", *FINGERPRINT, *[o for o in SKETCH if o in rows.columns], *more]
    classed = rows.select(*columns, F.floor(F.log(F.col("size").cast("double")) / math.log(STEP)).cast("int").alias("_class"))
    plan, pairs = tile_plan([tuple(r) for r in classed.groupBy("_class").agg(F.count("*"), F.min("size"), F.max("size")).collect()], tile_rows, least)
    names = ["_class", "_tile", "_tiles", "_first", "_last"]
    table = spark.createDataFrame(pa.table({n: pa.array([p[i] for p in plan], pa.int32()) for i, n in enumerate(names)}))
    own = (F.col("_tile") + F.pmod(F.xxhash64("node"), F.col("_tiles"))).cast("int")
    # Tiles of one class have the same partners: all from _first to _last.
    dealt = classed.join(F.broadcast(table), "_class").withColumn("_own", own).withColumn("_other", F.explode(F.sequence("_first", "_last")))
    keyed = dealt.select(F.least("_own", "_other").alias("_a"), F.greatest("_own", "_other").alias("_b"), (F.col("_own") > F.col("_other")).cast("int").alias("_side"), *columns)
    parts = max(1, min(pairs, 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    sorted_rows = keyed.repartition(parts, "_a", "_b").sortWithinPartitions("_a", "_b", "_side")

    def run(batches):
        left, at = None, None
        for (a, b, side), table in consecutive(batches, 3):
            tile = Tile.of(table, more)
            if a == b:
                yield from visit(tile, tile)
            elif side == 0:
                left, at = tile, (a, b)
            elif at == (a, b):
                yield from visit(left, tile)

    return small_batches(sorted_rows).mapInArrow(run, schema)


def batch_of(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns.values()], names=list(columns))


def crowds(nodes: DataFrame, least: tuple[int, int], tile_rows: int) -> DataFrame:
    """(node, crowd) of nodes that have candidates: how many within the bits that the least similarity differs by on average."""
    close = radius_of(64 * PLANES, least) - SPREAD * math.sqrt(64 * PLANES) / 3

    def visit(a, b):
        met = [np.zeros(len(t.node), np.int64) for t in (a, b)]
        near = [np.zeros(len(t.node), np.int64) for t in (a, b)]
        for i, j, bits in candidates(a, b, least):
            for k, at in enumerate((i, j)):
                met[k] += np.bincount(at, minlength=len(met[k]))
                near[k] += np.bincount(at[bits <= close], minlength=len(met[k]))
        for t, m, n in zip((a, b), met, near):
            yield batch_of(node=t.node[m > 0], crowd=n[m > 0])

    return over_tiles(nodes, [], visit, "node long, crowd long", least, tile_rows).groupBy("node").agg(F.sum("crowd").alias("crowd"))


def best_partners(rows: DataFrame, least: tuple[int, int], tile_rows: int, nearest: bool) -> DataFrame:
    """(a, b), a < b: each node b (or a) with one candidate of another class: the nearest, or that of the largest crowd; ties by
    node. ``rows`` have ``crowd`` and ``root``."""

    def visit(a, b):
        rank = {}
        for k, t in enumerate((a, b)):  # the higher the better: crowd, then the smaller node
            order = np.lexsort((~t.node, t.more["crowd"]))
            rank[k] = np.empty(len(order), np.int64)
            rank[k][order] = np.arange(len(order))
        wide, best = max(len(a.node), len(b.node)) + 1, [np.full(len(t.node), -1, np.int64) for t in (a, b)]
        for i, j, bits in candidates(a, b, least):
            other = a.more["root"][i] != b.more["root"][j]
            i, j, bits = i[other], j[other], bits[other]
            close = 1_000_000 - np.minimum(bits * 1_000_000 // (a.size[i] + b.size[j]), 1_000_000)
            for k, (at, of, ranks) in enumerate(((i, j, rank[1]), (j, i, rank[0]))):
                np.maximum.at(best[k], at, ranks[of] + (close * wide if nearest else 0))
        for k, (t, o) in enumerate(((a, b), (b, a))):
            found = best[k] >= 0
            partner = np.argsort(rank[1 - k])[best[k][found] % wide]
            score = best[k][found] // wide if nearest else o.more["crowd"][partner]
            yield batch_of(node=t.node[found], score=score, partner=o.node[partner])

    found = over_tiles(rows, ["crowd", "root"], visit, "node long, score long, partner long", least, tile_rows)
    best = found.groupBy("node").agg(F.max(F.struct("score", F.bitwise_not("partner").alias("p"))).alias("best"))
    partner = F.bitwise_not(F.col("best.p"))
    return best.select(F.least("node", partner).alias("a"), F.greatest("node", partner).alias("b")).distinct()


def pairs_apart(rows: DataFrame, least: tuple[int, int], tile_rows: int) -> DataFrame:
    """(a, b), a < b: every candidate pair of different classes."""

    def visit(a, b):
        for i, j, _ in candidates(a, b, least):
            other = a.more["root"][i] != b.more["root"][j]
            x, y = a.node[i[other]], b.node[j[other]]
            yield batch_of(a=np.minimum(x, y), b=np.maximum(x, y))

    return over_tiles(rows, ["root"], visit, "a long, b long", least, tile_rows)


def whole_sets(docs: DataFrame, prints: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles): the whole sets of the wanted nodes, from one document of each."""

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                node, texts = batch.slice(i, 128).columns
                yield pa.RecordBatch.from_arrays([node, pa.array([s.tobytes() for s in shingle_sets(texts.to_pylist(), words)], pa.binary())], names=["node", "shingles"])

    one = prints.join(wanted, "node", "left_semi").groupBy("node").agg(F.min(F.struct(known("doc_id"), "alike")).alias("of"))
    one = materialize(one.select("node", "of._kept", F.col("of.alike").alias("_alike")), "wanted")
    n = one.count()
    texts = docs.select("doc_id", "text").select(known("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_alike"), "text")
    # Three longs a row are broadcast up to a fixed number of rows; more are dealt by id.
    found = texts.join(F.broadcast(one) if n <= BROADCAST_ROWS else one, ["_kept", "_alike"]).select("node", "text")
    sets = materialize(small_batches(found).mapInArrow(run, "node long, shingles binary"), "sets")
    discard(one)
    return sets if sets.count() == n else materialize(sets.dropDuplicates(["node"]), "sets")  # documents that come repeatedly


def verified(pairs: DataFrame, sets: DataFrame, least: tuple[int, int]) -> DataFrame:
    """Those pairs (a, b) whose sets are similar enough.

    Each end of a pair gets its set by (node, key), the key taken from the other end, so that a node of very many partners is spread
    over as many tasks as its share of the pairs asks for; its set is copied to them.
    """
    keys = max(1, pairs.count() // PAIRS)

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(*[c.to_pylist() for c in batch.columns[2:]]):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both * least[1] >= (len(x) + len(y) - both) * least[0])
            mask = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(k).filter(mask) for k in (0, 1)], names=["a", "b"])

    both = pairs
    for end, other, name in (("a", "b", "left"), ("b", "a", "right")):
        key = F.pmod(F.xxhash64(other), F.lit(keys)).cast("int").alias("key")
        copies = pairs.select(end, key).distinct().join(sets.toDF(end, name), end)
        both = both.withColumn("key", key).join(copies, [end, "key"]).drop("key")
    return materialize(small_batches(both.select("a", "b", "left", "right")).mapInArrow(run, "a long, b long"), "links")


def near_components(docs: DataFrame, words: int = SET_WORDS, least: tuple[int, int] = LEAST, tile_rows: int = SIMILAR_TILE_ROWS) -> DataFrame:
    """(doc_id, component_id): the smallest doc_id reachable by links of similarity ``least`` (a fraction) or more."""
    prints = materialize(set_prints(docs, words), "prints")
    alike = prints.where("size > 0").groupBy("node")
    nodes = materialize(alike.agg(F.first("size").alias("size"), *[F.first(f).alias(f) for f in [*FINGERPRINT, *SKETCH]]), "nodes")
    crowd = materialize(crowds(nodes.select("node", "size", *FINGERPRINT), least, tile_rows), "crowds")
    active = materialize(nodes.join(crowd, "node").withColumn("root", F.col("node")), "active")
    sets = tried = found = label = None
    for pick in ("crowd", "nearest", "all"):
        rows = active
        if label is not None:
            rows = materialize(active.drop("root").join(label.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node")), "active")
        pairs = pairs_apart(rows, least, tile_rows) if pick == "all" else best_partners(rows, least, tile_rows, pick == "nearest")
        pairs = materialize(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        if pairs.isEmpty():
            break
        if sets is None:  # at first every node that has a candidate is in a pair
            sets = whole_sets(docs, prints, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), words)
        links = verified(pairs, sets, least)
        found, tried = links if found is None else found.union(links), pairs if tried is None else tried.union(pairs)
        label = components(found)
    classed = prints.groupBy("node").agg(F.min("doc_id").alias("first"))
    if label is not None:
        classed = classed.join(label.toDF("node", "root"), "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        classed = classed.withColumn("root", F.col("node"))
    classed = materialize(classed, "classes")
    labels = materialize(join_hot(classed, classed.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("node", "component_id"), "labels")
    ids = materialize(prints.select("doc_id", "node"), "ids")
    discard(prints, nodes, crowd, active, classed)
    return join_hot(ids, labels, "node").select("doc_id", "component_id")


def known(column: str) -> Column:
    """The id, a null one as the smallest long."""
    return F.coalesce(F.col(column).cast("long"), F.lit(-(1 << 63))).alias("_kept")


def smallest_of(docs: DataFrame, of: DataFrame) -> DataFrame:
    """The documents of smallest doc_id of each class of ``of`` (doc_id, component_id); rows that repeat a kept document go."""
    kept = materialize(of.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(known("doc_id")).distinct(), "kept")
    alike = F.xxhash64(F.coalesce(F.col("row.text"), F.lit(""))).alias("_alike")
    rows = docs.select(F.struct(*docs.columns).alias("row")).select("row", known("row.doc_id"), alike)
    # The join deals the rows by id, which the removal of repeated rows needs as well: the texts move once.
    return rows.join(kept, "_kept", "left_semi").dropDuplicates(["_kept", "_alike"]).select("row.*")


def keep_one(docs: DataFrame, words: int = SET_WORDS, least: tuple[int, int] = LEAST) -> DataFrame:
    """The documents of smallest doc_id of each class of near copies, with their columns; rows that repeat a kept document go."""
    return smallest_of(docs, near_components(docs, words, least))

