"""Benchmark decontamination by pigeonhole edit matching.

Texts are compared as words (lower-cased runs of word characters; in scripts that write no spaces, such as Han, kana, Thai or Khmer,
each character is one). An item of n words has an error budget of
k = floor(error_rate * n) inserted, deleted or changed words. It is split into k + 1 pieces; wherever a document holds
the item within k errors, at least one piece stands there unchanged. Exact piece hits come from one Aho-Corasick
pass over each whole document, and Myers' bit-parallel distance verifies the windows around them, so a hit alone
never counts and no match within the budget is missed.

The items go to the executors in blocks of at most ``block_chars`` characters, one pass for each block, so what is
sent has a fixed bound and a large benchmark is still matched whole.

Defined cases: null and empty texts and texts without a word match nothing; items of fewer than 5 words have no error budget
and match exactly; a caller who thinks that short items say too little raises ``min_words``, below which they match nothing;
very long texts are searched whole; of equally good places in a text the first is reported; repeated items are each
reported; repeated documents are each reported; empty tables give an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgrid.llm.shared import small_batches

ERROR_RATE = 0.2
MIN_WORDS = 1
BLOCK_CHARS = 4_000_000
#: Thai and Lao, Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff"
WORD = re.compile(rf"[{UNSPACED}]|[^\W{UNSPACED}]+")


def words_of(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def pieces(words: list[str], budget: int) -> list[tuple[int, str]]:
    """(first word, text) of budget + 1 pieces of almost the same number of words."""
    cuts = [len(words) * i // (budget + 1) for i in range(budget + 2)]
    return [(a, f" {' '.join(words[a:b])} ") for a, b in zip(cuts, cuts[1:])]


def myers(pattern: list[str], text: list[str]) -> tuple[int, int]:
    """Least distance of the pattern to any stretch of the text, and where the first such stretch ends."""
    m = len(pattern)
    masks: dict[str, int] = {}
    for i, w in enumerate(pattern):
        masks[w] = masks.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    up, down, score, best = full, 0, m, (m, 0)
    for j, w in enumerate(text, 1):
        eq = masks.get(w, 0)
        diagonal = ((((eq & up) + up) ^ up) | eq | down) & full
        plus, minus = down | (full & ~(diagonal | up)), up & diagonal
        score += bool(plus & top) - bool(minus & top)
        if score < best[0]:
            best = (score, j)
        plus, minus = plus << 1, minus << 1  # row 0 stays 0: the pattern may start anywhere
        up, down = full & (minus | ~(diagonal | plus)), full & plus & diagonal
    return best


class Matcher:
    """Finds a block of items in texts."""

    def __init__(self, items: list[tuple[int, str]], error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS) -> None:
        self.items = []
        at: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            words = words_of(text)
            if len(words) < max(min_words, 1):
                continue
            budget = int(error_rate * len(words) + 1e-9)
            for first, piece in pieces(words, budget):
                at.setdefault(piece, []).append((len(self.items), first))
            self.items.append((item_id, words, budget))
        self.automaton = ahocorasick.Automaton()
        for piece, uses in at.items():
            self.automaton.add_word(piece, (len(piece), uses))
        if at:
            self.automaton.make_automaton()

    def find(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item_id, edits, words of the item, last word of the first best match) of each item in the text."""
        words = words_of(text) if self.items and text else []
        if not words:
            return []
        joined = f" {' '.join(words)} "
        hits = [(end, size, uses) for end, (size, uses) in self.automaton.iter(joined)]
        if not hits:
            return []
        starts = np.cumsum([1] + [len(w) + 1 for w in words[:-1]])
        windows: dict[int, list[list[int]]] = {}
        for end, size, uses in hits:
            at = int(np.searchsorted(starts, end - size + 2))
            for item, first in uses:
                _, pattern, budget = self.items[item]
                low, high = max(0, at - first - budget), at - first + len(pattern) + budget
                spans = windows.setdefault(item, [])
                spans.append([low, high])
        found = []
        for item, spans in windows.items():
            item_id, pattern, budget = self.items[item]
            merged: list[list[int]] = []
            for low, high in sorted(spans):
                if merged and low <= merged[-1][1]:
                    merged[-1][1] = max(high, merged[-1][1])
                else:
                    merged.append([low, high])
            edits, last = min(((d, low + e - 1) for low, high in merged for d, e in [myers(pattern, words[low:high])]), default=(budget + 1, 0))
            if edits <= budget:
                found.append((item_id, edits, len(pattern), last))
        return found


def blocks(benchmark: DataFrame, block_chars: int = BLOCK_CHARS) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of bounded size; the driver holds one at a time."""
    block, held = [], 0
    for item_id, text in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        if block and held + len(text) > block_chars:
            yield block
            block, held = [], 0
        block.append((item_id, text))
        held += len(text)
    if block:
        yield block


def leaks(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id, edits, item_words, last_word) of every item that a document holds within its budget."""
    schema = "doc_id long, item_id long, edits int, item_words int, last_word long"
    texts, out = small_batches(docs).select(F.col("doc_id").cast("long"), "text"), None
    for block in blocks(benchmark, block_chars):

        def run(batches, block=block):
            matcher = Matcher(block, error_rate, min_words)
            for batch in batches:
                rows = [(d, *hit) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for hit in matcher.find(t)]
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()))], names=["doc_id", "item_id", "edits", "item_words", "last_word"])

        part = texts.mapInArrow(run, schema)
        out = part if out is None else out.union(part)
    return texts.mapInArrow(lambda batches: iter(()), schema) if out is None else out


def clean_column(block: list[tuple[int, str]], error_rate: float, min_words: int, text: str = "text") -> Column:
    """Whether the whole text holds none of a block of items."""

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        matcher = Matcher(block, error_rate, min_words)
        for part in parts:
            yield pd.Series([not matcher.find(t) for t in part.tolist()], dtype=bool)

    return clean(F.col(text))


def decontaminate(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE, min_words: int = MIN_WORDS, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """The documents that hold no item within its budget, with their columns."""
    for block in blocks(benchmark, block_chars):
        docs = small_batches(docs).where(clean_column(block, error_rate, min_words))
    return docs
