import random
import zlib

import numpy as np
import pytest

from loomgrid.llm import toxicity as t


@pytest.fixture(scope="module")
def labelled(spark, prose):
    rng, rows, labels = random.Random(3), [], []
    for i in range(400):
        words = prose(40).split()
        bad = i % 4 == 0
        if bad:
            for w in ("grubber", "slimebag"):
                words.insert(rng.randrange(40), w)
        rows.append((i, " ".join(words)))
        if i % 10:
            labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_rows_are_told_apart(labelled):
    out = t.toxicity(*labelled).collect()
    assert len(out) == 400 and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in out)
    assert all(r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for r in out)
    held = [r for r in out if r.held_out]
    assert sum(r.predicted == (r.doc_id % 4 == 0) for r in held) >= 0.97 * len(held)
    weights = t.learn(*labelled)
    assert 0 < len(weights.value) < 3000
    assert t.learn(*labelled).value.tolist() == weights.value.tolist()


def test_features_are_grams_and_skip_grams():
    hashes = t.Hashes()
    row, gram = t.features(["A b c", None, "", "b"], hashes)
    assert np.bincount(row, minlength=4).tolist() == [3 + 2 + 1, 0, 0, 1]
    _, again = t.features(["b"], hashes)
    assert again[0] in gram and len(set(gram[row == 0])) == 6


def test_ftrl_matches_plain_updates():
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 16, 5)).astype(np.int32), int(rng.integers(2))) for _ in range(50)]
    alpha, beta, l1, l2 = 0.5, 1.0, 0.3, 0.1
    got = t.ftrl(rows, bits=4, epochs=2, alpha=alpha, beta=beta, l1=l1, l2=l2)
    z, n = [0.0] * 17, [0.0] * 17
    weight = lambda i: 0.0 if i < 16 and abs(z[i]) <= l1 else -(z[i] - (np.sign(z[i]) * l1 if i < 16 else 0)) / ((beta + n[i] ** 0.5) / alpha + l2)
    for _ in range(2):
        for index, y in rows:
            at = [*index.tolist(), 16]
            w = [weight(i) for i in at]
            g = 1 / (1 + np.exp(-sum(w))) - y
            for i, v in zip(at, w):
                z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / alpha * v
                n[i] += g * g
    want = [weight(i) for i in range(16)]
    dense = np.zeros(16)
    dense[got.index] = got.value
    assert np.allclose(dense, want, atol=1e-6) and np.isclose(got.bias, weight(16))


def test_odd_rows(spark, labelled, documents, no_documents, clashing):
    out = t.toxicity(documents, labelled[1]).collect()
    assert len(out) == documents.count()
    empty = {round(r.score, 12) for r in out if r.doc_id in (22, 23, 24)}
    assert len(empty) == 1
    assert t.toxicity(no_documents, labelled[1]).count() == 0
    none = t.toxicity(documents, labelled[1].limit(0)).collect()
    assert all(r.score < 1e-9 and r.predicted == 0 for r in none)
    odd = spark.createDataFrame([(1, None), (1, 1), (None, 1), (2, 7), (3, 0), (3, 1)], "doc_id long, toxic int")
    assert t.toxicity(documents, odd).count() == documents.count()
    kept = t.reject(clashing, t.learn(*labelled))
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    assert t.reject(labelled[0], t.learn(*labelled)).count() == 300
