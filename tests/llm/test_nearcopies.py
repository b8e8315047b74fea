import itertools
import random

import numpy as np
import pytest

from loomgrid.llm import simhash


def plain(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or ({tuple(words)} if words else set())


def classes(texts):
    """Smallest id reachable by links of Jaccard 0.8 or more, by brute force."""
    sets, up = {i: plain(t) for i, t in texts.items()}, {i: i for i in texts}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in itertools.combinations(texts, 2):
        a, b = sets[i], sets[j]
        if 5 * len(a & b) >= 4 * len(a | b):
            i, j = find(i), find(j)
            up[max(i, j)] = min(i, j)
    return {i: find(i) for i in texts}


@pytest.fixture(scope="module")
def copies(prose):
    """Texts with edits around the threshold, chains of edits, one large group, a common line, short and empty texts."""
    rng, texts = random.Random(9), []
    line = prose(12, seed=1)
    for size in (3, 4, 5, 6, 9, 14, 30, 60, 150, 400):
        for _ in range(6):
            words = prose(size).split()
            texts.append(" ".join(words))
            for _ in range(4):
                words = words[:]  # a chain: each edits the one before
                for at in rng.sample(range(len(words)), max(1, len(words) * rng.randrange(1, 5) // 100)):
                    words[at] = f"edit{rng.randrange(10**6)}"
                texts.append(" ".join(words + (["tail"] * rng.randrange(0, 3))))
    base = prose(80).split()
    for _ in range(120):
        at = rng.randrange(80)
        texts.append(" ".join(base[:at] + [f"new{rng.randrange(10**6)}"] + base[at + 1 :]))
    texts += [f"{line} {prose(rng.randrange(1, 6))}" for _ in range(40)] + ["", " \n", None, "Word", "word"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return dict(zip(order, texts))


@pytest.mark.parametrize("tile_rows", [40, simhash.SIMILAR_TILE_ROWS])
def test_classes_are_those_of_brute_force(spark, copies, tile_rows, monkeypatch):
    monkeypatch.setattr(simhash, "PAIRS", 16)  # nodes of several pairs are spread
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 0 if tile_rows == 40 else 1_000_000)
    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(3)
    assert {r.doc_id: r.component_id for r in simhash.near_components(docs, tile_rows=tile_rows).collect()} == classes(copies)


def test_the_pipeline_keeps_one_of_each_group(spark, copies):
    from corpus_pipeline import near_copies_out

    docs = spark.createDataFrame(list(copies.items()), "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in near_copies_out(spark, docs, "").collect()) == sorted(set(classes(copies).values()))


def test_odd_rows(documents, no_documents, clashing):
    of = {r.doc_id: r.component_id for r in simhash.near_components(documents).collect() if r.doc_id is not None}
    kept = simhash.keep_one(clashing)
    assert kept.columns == clashing.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(of.values()))
    assert simhash.keep_one(no_documents).count() == 0


def test_repeated_rows_do_not_multiply(spark, prose):
    words = prose(100).split()
    rows = [(1, " ".join(words))] * 50 + [(2, " ".join(words + ["end"]))] * 50 + [(3, prose(100))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in simhash.keep_one(docs).collect()) == [1, 3]


def test_tile_plan_pairs_all_sizes_that_may_be_similar():
    rng = np.random.default_rng(3)
    for tile_rows in (5, 50, 10_000):
        sizes = np.unique(np.exp(rng.uniform(0, 6, 200)).astype(int))
        rows = [(int(np.log(s) / np.log(simhash.STEP)), int(rng.integers(1, 30)), int(s), int(s)) for s in sizes]
        merged = {}
        for c, n, low, high in rows:
            old = merged.get(c, (c, 0, low, high))
            merged[c] = (c, old[1] + n, min(low, old[2]), max(high, old[3]))
        plan, pairs = simhash.tile_plan(list(merged.values()), tile_rows, (4, 5))
        of = {p[0]: p for p in plan}
        met = {(t, u) for p in plan for t in range(p[1], p[1] + p[2]) for u in range(p[3], p[4] + 1)}
        assert met == {(u, t) for t, u in met} and pairs == sum(t <= u for t, u in met)
        for a, b in itertools.combinations(merged.values(), 2):
            if min(a[3], b[3]) * 5 >= max(a[2], b[2]) * 4:
                p, q = of[a[0]], of[b[0]]
                assert all((t, u) in met for t in range(p[1], p[1] + p[2]) for u in range(q[1], q[1] + q[2]))


def test_parity_sketches_bound_the_difference():
    rng = np.random.default_rng(6)
    for size in (9, 90, 900, 9000):
        whole = rng.integers(0, 1 << 64, size * 2, dtype=np.uint64)
        a, limits = whole[:size], simhash.parity_limits(3 * size, (4, 5))
        for share in (0.85, 0.81, 0.5):
            both = round(2 * size * share / (1 + share))
            b = np.concatenate([a[:both], whole[size : 2 * size - both]])
            x, y = (simhash.parity(s, np.zeros(len(s), np.int64), 1)[:, 0] for s in (a, b))
            bits, similar = int(np.bitwise_count(x ^ y).sum()), len(np.intersect1d(a, b)) * 5 >= len(np.union1d(a, b)) * 4
            assert bits <= 2 * (size - both) and (bits <= limits[len(a) + len(b)] or not similar)
            assert similar or size > 900 or bits > limits[len(a) + len(b)]  # large sets fill the sketch


def test_radius_holds_similar_sets():
    rng, far = np.random.default_rng(5), 0
    for size in (9, 20, 90, 900):
        whole = rng.integers(0, 1 << 63, (200, size + size // 8), dtype=np.uint64)
        both = size - size // 9  # in common: a similarity of 0.8 or just above
        for row in whole:
            a, b = row[:size], np.concatenate([row[:both], row[size:]])
            bits = [int(np.bitwise_count(simhash.majority(simhash.plane(a, k), np.array([len(a)])) ^ simhash.majority(simhash.plane(b, k), np.array([len(b)])))[0]) for k in range(4)]
            far += bits[0] > simhash.radius_of(64) or sum(bits) > simhash.radius_of(256)
    assert far <= 1
