"""Language identification by a byte convolutional network, trained and applied with numpy.

Bytes are embedded, filters of several widths slide over them, each filter's largest answer in a window is kept, and a
softmax over those names the language. Learning takes a bounded sample of labelled rows: for each language at most
``sample_rows`` documents (those of the smallest hashes of doc_id), and at most ``most_rows`` of all languages together, and a few
windows of each. Every text is predicted whole: all its windows of ``WINDOW`` bytes count, in proportion to the bytes that they
hold.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0; null labels aren't learned
from; without any labelled row every text is ``und``; with one language every text with a letter is that; of languages of equal
score the first by name; very long texts are predicted by all their windows; repeated rows are each predicted; null doc_ids are
never learned from nor held out; an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomgrid.llm.shared import slot, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
SAMPLE_ROWS = 600
MOST_ROWS = 60_000
SAMPLE_WINDOWS = 4
STEPS, BATCH, RATE = 1200, 64, 0.01
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether any character is of Unicode's category L, as ``\\p{L}`` says for Spark."""
    return bool(text) and any(map(str.isalpha, text))


def windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All windows of all texts, zero-padded: (bytes, row of each, bytes that count in each)."""
    count = np.array([max(1, -(-len(t) // WINDOW)) for t in texts])
    data = np.frombuffer(b"".join(t.ljust(int(k) * WINDOW, b"\0") for t, k in zip(texts, count)), np.uint8).reshape(-1, WINDOW)
    row = np.repeat(np.arange(len(texts)), count)
    size = np.full(len(row), WINDOW, np.float32)
    size[np.cumsum(count) - 1] = [len(t) - (int(k) - 1) * WINDOW for t, k in zip(texts, count)]
    return data, row, size


@dataclass
class Network:
    """embed: 256 x EMBED; filters: widest * EMBED x all filters, zero beyond a filter's width; out, bias: softmax."""

    langs: list[str]
    embed: np.ndarray
    filters: np.ndarray
    shift: np.ndarray
    out: np.ndarray
    bias: np.ndarray

    def columns(self, data: np.ndarray) -> np.ndarray:
        """Each position's embedded bytes, as many as the widest filter sees."""
        wide = max(WIDTHS)
        x = self.embed[np.pad(data, ((0, 0), (0, wide - 1)))]
        view = np.lib.stride_tricks.as_strided(x, (len(x), data.shape[1], wide * EMBED), x.strides[:2] + x.strides[2:])
        return np.ascontiguousarray(view)

    def log_probabilities(self, data: np.ndarray) -> np.ndarray:
        parts = []
        for i in range(0, len(data), 64):
            cols = self.columns(data[i : i + 64])
            seen = (cols.reshape(-1, cols.shape[2]) @ self.filters).reshape(len(cols), -1, self.filters.shape[1])
            top = np.maximum(seen.max(1) + self.shift, 0)
            z = top @ self.out + self.bias
            z -= z.max(1, keepdims=True)
            parts.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(parts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        some = [i for i, t in enumerate(texts) if has_letter(t)]
        if some and self.langs:
            data, row, size = windows([texts[i].encode() for i in some])
            logs = self.log_probabilities(data) * size[:, None]
            mean = np.add.reduceat(logs, np.flatnonzero(np.r_[True, row[1:] != row[:-1]])) / np.bincount(row, size)[:, None]
            p = np.exp(mean - mean.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for i, k, v in zip(some, p.argmax(1), p.max(1)):
                names[i], scores[i] = self.langs[k], v
        return names, np.clip(scores, 0, 1)


def filter_mask() -> np.ndarray:
    """Which rows of ``filters`` each filter has."""
    wide = max(WIDTHS)
    return np.concatenate([np.repeat(np.arange(wide) < w, EMBED)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)


def gradients(net: Network, data: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean cross entropy of windows, and its gradients by embed, filters, shift, out and bias."""
    rows, wide = len(data), max(WIDTHS)
    cols = net.columns(data)
    seen = (cols.reshape(-1, cols.shape[2]) @ net.filters).reshape(rows, -1, net.filters.shape[1])
    at = seen.argmax(1)
    top = np.maximum(np.take_along_axis(seen, at[:, None], 1)[:, 0] + net.shift, 0)
    z = top @ net.out + net.bias
    z = z - z.max(1, keepdims=True)
    p = np.exp(z)
    p /= p.sum(1, keepdims=True)
    loss = -float(np.log(np.maximum(p[np.arange(rows), y], 1e-30)).mean())
    dz = p / rows
    dz[np.arange(rows), y] -= 1 / rows
    dtop = (dz @ net.out.T) * (top > 0)
    best = cols[np.arange(rows)[:, None], at]  # what each filter answered to: rows x filters x columns
    dfilters = np.einsum("bf,bfc->cf", dtop, best) * filter_mask()
    dcols = (dtop[:, :, None] * net.filters.T[None]).reshape(-1, EMBED)
    seen_bytes = np.pad(data, ((0, 0), (0, wide - 1)))[np.arange(rows)[:, None, None], at[:, :, None] + np.arange(wide)]
    dembed = np.zeros_like(net.embed)
    np.add.at(dembed, seen_bytes.ravel(), dcols)
    return loss, [dembed, dfilters, dtop.sum(0), top.T @ dz, dz.sum(0)]


def train(samples: list[tuple[str, bytes]], steps: int = STEPS, seed: int = 7) -> Network:
    """Adam on the cross entropy of windows; languages are drawn equally often."""
    langs = sorted({lang for lang, _ in samples})
    rng, wide, n = np.random.default_rng(seed), max(WIDTHS), FILTERS * len(WIDTHS)
    normal = lambda scale, *shape: rng.normal(0, scale, shape).astype(np.float32)
    net = Network(langs, normal(0.5, 256, EMBED), normal(0.25, wide * EMBED, n) * filter_mask(), np.zeros(n, np.float32), normal(0.1, n, len(langs)), np.zeros(len(langs), np.float32))
    if len(langs) < 2:
        return net
    by_lang = [np.concatenate([windows([t])[0] for la, t in samples if la == lang]) for lang in langs]
    params = [net.embed, net.filters, net.shift, net.out, net.bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    for step in range(1, steps + 1):
        y = rng.integers(len(langs), size=BATCH)
        data = np.stack([by_lang[k][rng.integers(len(by_lang[k]))] for k in y])
        rate = RATE * (1 - step / (steps + 1))
        for q, g, (m, v) in zip(params, gradients(net, data, y)[1], moments):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            q -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return net


def learn(docs: DataFrame, where: Column | None = None, sample_rows: int = SAMPLE_ROWS, sample_windows: int = SAMPLE_WINDOWS, most_rows: int = MOST_ROWS) -> Network:
    """A network from at most ``sample_rows`` documents of each language among those that ``where`` keeps, and ``most_rows`` (or one a
    language) in all."""
    known = docs.where("lang is not null")
    known = known if where is None else known.where(where)
    hashed = known.where(F.col("text").rlike(r"\p{L}")).select("doc_id", "lang", F.xxhash64("doc_id").alias("_h"))
    # A bound on the hash of each language, from its count, keeps about three times the rows wanted; then the smallest. The counts are one
    # row for each language.
    counts = known.groupBy("lang").count()
    sample_rows = max(1, min(sample_rows, most_rows // max(1, counts.count())))
    near = hashed.join(F.broadcast(counts), "lang").where((F.col("_h").cast("double") / 2.0**64 + 0.5) * F.col("count") <= 3.0 * sample_rows + 100)
    picked = near.withColumn("_k", F.row_number().over(Window.partitionBy("lang").orderBy("_h", "doc_id"))).where(F.col("_k") <= sample_rows)
    ids = F.broadcast(picked.select("doc_id", "lang"))  # at most sample_rows for each language
    chars = WINDOW
    starts = [F.pmod(F.xxhash64("doc_id", F.lit(i)), F.greatest(F.length("text") - chars, F.lit(0)) + 1).cast("int") + 1 for i in range(sample_windows)]
    parts = F.array_distinct(F.array(*[F.substr("text", s, F.lit(chars)) for s in starts]))
    rows = docs.select("doc_id", "lang", "text").join(ids, ["doc_id", "lang"]).select("doc_id", "lang", F.explode(parts).alias("part")).dropDuplicates()
    got = sorted((r.lang, r.doc_id, r.part) for r in rows.collect())
    return train([(lang, part.encode()) for lang, _, part in got if has_letter(part)])


def predict_column(net: Network, text: str = "text") -> Column:
    """(lang_pred, score) of the whole text."""

    @F.pandas_udf("lang_pred string, score double")
    def predict(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for part in parts:
            texts, names, scores = part.tolist(), [], [np.zeros(0)]
            for i in range(0, len(texts), 128):
                some, p = net.predict(texts[i : i + 128])
                names += some
                scores.append(p)
            yield pd.DataFrame({"lang_pred": names, "score": np.concatenate(scores)})

    return predict(F.col(text))


def identify(docs: DataFrame, folds: int = 4, held: int = 2) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; fold ``held`` of its id is never learned from."""
    net = learn(docs, slot("doc_id", folds) != held)
    out = small_batches(docs).select("doc_id", F.coalesce(slot("doc_id", folds) == held, F.lit(False)).alias("held_out"), predict_column(net).alias("_p"))
    return out.select("doc_id", "held_out", "_p.lang_pred", "_p.score")
