import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgrid.llm import vecdedup as v

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(ids, x, threshold):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = x @ x.T >= threshold
    np.fill_diagonal(linked, False)
    component = np.array(ids)
    while True:
        new = np.array([min([component[i], *component[linked[i]]]) for i in range(len(ids))])
        if (new == component).all():
            return {i: (int(n), int(c), i == c) for i, n, c in zip(ids, linked.sum(1), component)}
        component = new


@pytest.fixture(scope="module")
def vectors():
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 64))
    rows = [centres[rng.integers(40)] + rng.normal(0, s, 64) for s in (0.05, 0.15, 0.2, 0.24, 0.3) for _ in range(70)]
    rows += [rows[0] * 3, rows[0], rows[0], np.eye(64)[0], -np.eye(64)[0]]
    return np.array(rows, np.float32)


def run(spark, ids, x, **options):
    df = spark.createDataFrame([(int(i), [float(c) for c in r], 0) for i, r in zip(ids, x)], SCHEMA)
    return {r.vec_id: (r.n_links, r.component_id, r.kept) for r in v.vector_components(df, **options).collect()}


def test_matches_brute_force(spark, vectors, monkeypatch):
    ids = np.random.default_rng(1).permutation(len(vectors)).tolist()
    want = brute(ids, vectors.astype(float), 0.95)
    assert sum(n for n, _, _ in want.values()) > 500
    assert run(spark, ids, vectors) == want
    assert run(spark, ids, vectors, grid_dims=3, block_dims=6, tile_rows=7) == want
    monkeypatch.setattr(v, "BROADCAST_ROWS", 0)
    assert run(spark, ids, vectors, grid_dims=1, block_dims=64, tile_rows=50) == want


@pytest.mark.parametrize("threshold", [0.8, 0.99])
def test_other_thresholds(spark, vectors, threshold):
    ids = list(range(len(vectors)))
    assert run(spark, ids, vectors, threshold=threshold) == brute(ids, vectors.astype(float), threshold)


def test_odd_vectors_link_with_nothing(spark):
    one = [1.0] + [0.0] * 7
    nan, inf = float("nan"), float("inf")
    rows = [(1, one), (2, one), (3, None), (4, [0.0] * 8), (5, [nan] + one[1:]), (6, [inf] + one[1:]), (7, [None] + one[1:]), (8, one[:4]), (9, [2.0] + one[1:]), (9, [2.0] + one[1:]), (10, [1e-30] + one[1:]), (11, [3.0, 0.0, 0.0, 0.0]), (12, [3.0]), (None, [0.0, 1.0] + [0.0] * 6)]
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).withColumns({"class_id": F.lit(1), "vector": F.lit(2), "first": F.lit(3), "copies": F.lit(4)})
    out = v.vector_components(df).collect()
    assert len(out) == len(rows)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert got[1] == (4, 1, True) and got[2] == (4, 1, False) and got[9] == (4, 1, False) and got[10] == (4, 1, False)
    assert all(got[i] == (0, i, True) for i in (3, 4, 5, 6, 7)) and got[8] == (1, 8, True) and got[11] == (1, 8, False) and got[None] == (0, None, True)
    assert v.vector_components(df.limit(0)).count() == 0
    doubles = df.withColumn("embedding", F.col("embedding").cast("array<double>"))
    assert {r.vec_id: r.n_links for r in v.vector_components(doubles).collect()} == {i: n for i, (n, _, _) in got.items()}
