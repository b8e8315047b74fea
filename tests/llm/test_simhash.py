import itertools
import math
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from loomgrid.llm import shared, simhash
from loomgrid.llm.shared import components


def plain(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("text", ["", "one", "one two", "One TWO\tthree", "a b c d e f g " * 50, "É é x   y\x1cz\x0bw", "ÀB c"])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain(text)


def test_links_are_exact(spark):
    rng, fps = random.Random(4), set()
    for _ in range(60):
        seed = rng.getrandbits(64)
        fps.add(seed)
        for _ in range(rng.randrange(5)):
            for b in rng.sample(range(64), rng.randrange(1, 6)):
                seed ^= 1 << b
            fps.add(seed)
    fps |= {0, (1 << 64) - 1, 1, 7, 15}
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    pairs = [(signed(a), signed(b)) for a, b in itertools.combinations(fps, 2) if (a ^ b).bit_count() <= 3]
    want = groups([signed(x) for x in fps], pairs)
    df = spark.createDataFrame([(signed(x),) for x in fps], "fp long")
    got = dict(components(simhash.links(df)).collect())
    linked = {x for p in pairs for x in p}
    assert got == {x: want[x] for x in linked}
    small = simhash.TILE_ROWS
    try:
        simhash.TILE_ROWS = 2  # cells are split into many tiles
        assert dict(components(simhash.links(df)).collect()) == got
    finally:
        simhash.TILE_ROWS = small


def test_components_of_chains_stars_and_loops(spark):
    rng = random.Random(1)
    chain = [(i, i + 1) for i in range(0, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)] + [(1000, 1000), (1000, 1001)]
    mixed = [(rng.randrange(2000, 2100), rng.randrange(2000, 2100)) for _ in range(70)]
    pairs = chain + star + mixed
    rng.shuffle(pairs)
    want = groups({x for p in pairs for x in p}, pairs)
    frame = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = dict(components(frame).collect())
    assert dict(components(frame, last_links=0).collect()) == got
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_documents_against_brute_force(documents):
    rows = documents.collect()
    prints = {i: plain(r.text) for i, r in enumerate(rows)}
    pairs = [(a, b) for a, b in itertools.combinations(prints, 2) if (prints[a] ^ prints[b]).bit_count() <= 3]
    classes = groups(prints, pairs)
    least = {}
    for i, c in classes.items():
        if rows[i].doc_id is not None:
            least[c] = min(least.get(c, 1 << 60), rows[i].doc_id)
    want = sorted((str(rows[i].doc_id), f"{prints[i]:016x}", least[classes[i]]) for i in prints)
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.simhash_components(documents).collect())
    assert got == want


def test_empty_tables_and_clashing_names(documents, no_documents, clashing):
    key = lambda df: sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())
    assert key(simhash.simhash_components(clashing)) == key(simhash.simhash_components(documents))
    assert simhash.simhash_components(no_documents).count() == 0


def test_rounds_are_logarithmic(spark, monkeypatch):
    rounds = []
    materialize = shared.materialize

    def counted(df, name, codec="snappy"):
        rounds.extend([name] * (name == "hooks"))
        return materialize(df, name, codec)

    monkeypatch.setattr(shared, "materialize", counted)
    chain = spark.range(1000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b"))
    for links, nodes in ((chain.repartition(300, "a"), 1001), (star.repartition(4), 100_001)):
        rounds.clear()
        got = components(links, reduced=True, last_links=0)
        assert got.where("component = 0").count() == got.count() == nodes
        assert len(rounds) <= 2 * math.log2(nodes)


def test_hot_keys_join_like_others(spark, monkeypatch):
    monkeypatch.setattr(shared, "HOT_ROWS", 10)
    monkeypatch.setattr(shared, "HOT_SHARE", 20)
    left = spark.createDataFrame([(k, i) for k in (1, 2, 7) for i in range(60)] + [(k, 0) for k in range(10, 30)] + [(None, 5)], "k long, i long")
    right = spark.createDataFrame([(k, f"v{k}") for k in (1, 2, *range(10, 25))], "k long, v string")
    for how in ("inner", "left"):
        assert sorted(map(str, shared.join_hot(left, right, "k", how).collect())) == sorted(map(str, left.join(right, "k", how).collect()))
