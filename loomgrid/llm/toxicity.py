"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashes of single words, neighbouring pairs and pairs with one word between, of the whole
lower-cased text. Learning takes a bounded sample of labelled rows (``sample_rows``, the smallest hashes of doc_id,
so the same at every run); per-coordinate rates and the L1 term leave a few thousand weights, whose number is bounded
by the hash space. Every text is scored whole.

Defined cases: null, empty and word-less texts score as the bias alone; very long texts count whole; labels other than 0 and 1 are ignored, of
several labels of a document the largest counts, and of several texts of one doc_id the first in order is learned from; without any labelled row every score is 0; with one class the bias
alone decides; repeated rows are each scored; null doc_ids are never learned from nor held out; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.shared import slot, small_batches

BITS = 20
SAMPLE_ROWS = 8_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 4.0, 1.0, 4.0, 0.1
CACHE_WORDS = 300_000
WORD = re.compile(r"[^\W_]+")


class Hashes(dict):
    """64-bit hashes of words, kept for words seen before."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE_WORDS:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def features(texts: list[str | None], hashes: Hashes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every gram of every text, repeats included."""
    words = [WORD.findall((t or "").lower()) for t in texts]
    row = np.repeat(np.arange(len(texts)), [len(w) for w in words])
    u = np.fromiter((hashes[w] for ws in words for w in ws), np.uint64, len(row))
    rows, grams = [row], [u]
    for gap, factor in ((1, 0x9E3779B97F4A7C15), (2, 0xC2B2AE3D27D4EB4F)):
        same = row[gap:] == row[:-gap]
        rows.append(row[gap:][same])
        grams.append(((u[:-gap] ^ (u[:-gap] >> np.uint64(29))) * np.uint64(factor) + u[gap:])[same])
    mixed = np.concatenate(grams) * np.uint64(0xD6E8FEB86659FD93)
    return np.concatenate(rows), (mixed >> np.uint64(64 - bits)).astype(np.int32)


@dataclass
class Weights:
    """What learning leaves: a bias and the weights that aren't zero."""

    bias: float
    index: np.ndarray
    value: np.ndarray
    bits: int = BITS

    def scorer(self):
        table = np.zeros(1 << self.bits, np.float32)
        table[self.index] = self.value
        hashes = Hashes()

        def score(texts: list[str | None]) -> np.ndarray:
            out = np.full(len(texts), self.bias)
            if texts:
                row, gram = features(texts, hashes, self.bits)
                hit = table[gram] != 0
                both = np.unique(row[hit].astype(np.int64) << self.bits | gram[hit])
                out += np.bincount(both >> self.bits, table[both & ((1 << self.bits) - 1)], len(texts))
            return 1 / (1 + np.exp(-np.clip(out, -60, 60)))

        return score


def ftrl(rows: list[tuple[np.ndarray, int]], bits: int = BITS, epochs: int = EPOCHS, alpha: float = ALPHA, beta: float = BETA, l1: float = L1, l2: float = L2) -> Weights:
    """One pass after another over (distinct features, label); the bias has its own rate and no L1 term."""
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    bias = lambda: -zb / ((beta + nb**0.5) / alpha + l2)
    for _ in range(epochs):
        for index, label in rows:
            zi, root = z[index], np.sqrt(n[index])
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            g = 1 / (1 + np.exp(-np.clip(w.sum() + bias(), -60, 60))) - label
            z[index] = zi + g - (np.sqrt(n[index] + g * g) - root) / alpha * w
            n[index] += g * g
            zb += g - ((nb + g * g) ** 0.5 - nb**0.5) / alpha * bias()
            nb += g * g
    used = np.flatnonzero(np.abs(z) > l1)
    value = (np.sign(z[used]) * l1 - z[used]) / ((beta + np.sqrt(n[used])) / alpha + l2)
    return Weights(float(bias()), used.astype(np.int32), value.astype(np.float32), bits)


def learn(docs: DataFrame, labels: DataFrame, where: Column | None = None, label: str = "toxic", sample_rows: int = SAMPLE_ROWS, **rates) -> Weights:
    """Weights from at most ``sample_rows`` labelled documents among those that ``where`` (of doc_id) keeps."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
    known = known if where is None else known.where(where)
    picked = known.groupBy("doc_id").agg(F.max(label).alias("_label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    texts = small_batches(docs).select("doc_id", "text").join(F.broadcast(picked), "doc_id")  # at most sample_rows
    texts = texts.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("_label").alias("_label"))

    def gather(batches):
        hashes = Hashes()
        for batch in batches:
            for i in range(0, batch.num_rows, 128):
                ids, part, y = batch.slice(i, 128).columns
                row, gram = features(part.to_pylist(), hashes)
                both = np.unique(row.astype(np.int64) << BITS | gram)
                cut = np.searchsorted(both >> BITS, np.arange(len(part) + 1))
                grams = (both & ((1 << BITS) - 1)).astype("<i4")
                yield pa.RecordBatch.from_arrays([ids, y.cast(pa.int32()), pa.array([grams[a:b].tobytes() for a, b in zip(cut, cut[1:])], pa.binary())], names=["doc_id", "label", "grams"])

    got = texts.select(F.col("doc_id").cast("long"), "text", "_label").mapInArrow(gather, "doc_id long, label int, grams binary").collect()
    got = sorted(got, key=lambda r: xxhash.xxh64_intdigest(str(r.doc_id)))
    if not got:
        return Weights(-60.0, np.zeros(0, np.int32), np.zeros(0, np.float32))
    return ftrl([(np.frombuffer(bytes(r.grams), "<i4"), r.label) for r in got], **rates)


def score_column(weights: Weights, text: str = "text") -> Column:
    """Score of the whole text: 0 to 1."""

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        of = weights.scorer()
        for part in parts:
            texts = part.tolist()
            yield pd.Series(np.concatenate([of(texts[i : i + 256]) for i in range(0, len(texts), 256)] or [np.zeros(0)]))

    return score(F.col(text))


def toxicity(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document; fold 0 of its id is never learned from."""
    weights = learn(docs, labels, slot("doc_id", folds) != 0)
    scored = small_batches(docs).select("doc_id", F.coalesce(slot("doc_id", folds) == 0, F.lit(False)).alias("held_out"), score_column(weights).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def reject(docs: DataFrame, weights: Weights, threshold: float = 0.5) -> DataFrame:
    """The documents below the threshold, with their columns."""
    return small_batches(docs).where(score_column(weights) < threshold)
