"""Token-ID / binary output: canonical length-limited Huffman coding of ids in independent blocks.

A written set has two tables below one path. ``codebook``: (token_id, bits), the canonical code is a function of
the lengths alone. ``blocks``: one row per block of whole documents with their doc_ids and token counts, the
packed bits, and a bit offset (checkpoint) for every ``checkpoint`` tokens, from which decoding can start. Rows
are committed by Spark's own writer, so a lost executor leaves no half-written block, and any store Spark can write
to will do.

Defined cases: null text is an empty text (one id, the end id); very long texts are encoded whole; an empty table gives empty
tables; rows that repeat a doc_id are all kept, ordered by the crc of their ids; null doc_ids come first and come back as null
(they are written as the smallest long, which therefore is no id); other columns are ignored.
"""

from __future__ import annotations

import itertools
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomgrid.llm.shared import chunked, discard, kept, materialize, small_batches

END_ID = 2
NO_ID = -(1 << 63)
MAX_BITS = 16
BLOCK_TOKENS = 1 << 18
CHECKPOINT = 128
CACHE_WORDS = 700_000

BLOCK_SCHEMA = "shard int, first long, tokens long, doc_ids binary, counts binary, offsets binary, bits binary"

# ---------------------------------------------------------------- encoding by the tokenizers library


LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
#: Texts of these characters alone, and with no apostrophe before a letter, can be cut at words.
PLAIN = re.compile(f"(?:[\\t\\n\\r -&(-~{LETTERS}]+|'(?![{LETTERS}]))*+")
#: What the pre-tokenizer keeps in one piece, so that the model alone can encode it.
ONE = re.compile(f" ?[{LETTERS}]+")
#: The byte-level alphabet spells a printable byte as itself and the others, in order, from 256 on.
PRINTABLE = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPELLED = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in PRINTABLE)}
SPACE = chr(SPELLED[32])
IS_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


class Encoder:
    """Ids of whole texts by the tokenizers library, which encodes each distinct piece once while it is cached.

    The byte-level pre-tokenizer joins letters with letters and with one space before them, so plain texts are cut
    around words, and before the last white space ahead of a word (how a run of it is split depends on what follows).
    Other texts are cut only where a space follows a visible character, which it never joins. New words go straight
    to the library's model, other new pieces through the whole tokenizer.
    """

    def __init__(self, path: str, kind: str, cache_words: int = CACHE_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Texts that hold the string of an added token (such as one that ends a text) are encoded whole, as the library does it.
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.kind, self.cache_words = np.dtype(kind), cache_words
        self.forget()

    def forget(self) -> None:
        self.known = Numbers()
        self.ids, self.held = np.zeros(1 << 16, self.kind), 0  # the ids of all pieces in a row
        self.ends = np.zeros(1 << 16, np.int64)  # where those of each piece end

    def learn(self) -> None:
        """Encode the pieces that came up since."""
        new, model = self.known.new, self.tokenizer.model
        ids: list[list[int]] = [[]] * len(new)
        rest = []
        for k, piece in enumerate(new):
            if ONE.fullmatch(piece):
                spelled = piece.replace(" ", SPACE) if piece.isascii() else piece.encode().decode("latin-1").translate(SPELLED)
                ids[k] = [t.id for t in model.tokenize(spelled)]
            else:
                rest.append(k)
        for some in chunked(rest, 4096):
            for k, e in zip(some, self.tokenizer.encode_batch_fast([new[k] for k in some], add_special_tokens=False)):
                ids[k] = e.ids
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        first, total = len(self.known) - len(new), self.held + int(sizes.sum())
        while len(self.ends) < len(self.known):
            self.ends = np.concatenate([self.ends, np.zeros_like(self.ends)])
        while len(self.ids) < total:
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ends[first : len(self.known)] = self.held + np.cumsum(sizes)
        self.ids[self.held : total] = np.fromiter(itertools.chain.from_iterable(ids), self.kind, total - self.held)
        self.held = total
        new.clear()

    def plain(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The pieces of plain texts, and the first piece of each text: one pass over the bytes, in which only letters are above 127.

        A word begins at its first letter, or at a space before it; another white space before it is a piece of its own.
        """
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        at = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        letter = IS_LETTER[data]
        first = np.zeros(len(data) + 1, bool)
        first[at] = True
        cut, first = first.copy(), first[:-1]
        after = np.zeros_like(letter)
        after[1:] = letter[:-1]
        after &= ~first  # the byte before is a letter of the same text
        cut[:-1] |= after & ~letter
        inner = np.flatnonzero(letter & ~after & ~first)
        before = data[inner - 1]
        cut[inner[before == 32] - 1] = True
        cut[inner[before != 32]] = True
        cut[inner[(before == 9) | (before == 10) | (before == 13)] - 1] = True
        offsets = np.flatnonzero(cut).astype(np.int32)
        pieces = pa.Array.from_buffers(pa.string(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])
        return pieces, np.searchsorted(offsets, at)

    def other(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The same of any texts."""
        cut = [re.split(r"(?<=\S)(?= )", t) for t in texts]
        return pa.array(list(itertools.chain.from_iterable(cut)), pa.string()), np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        if len(self.known) > self.cache_words:
            self.forget()
        kinds = [2 if any(s in t for s in self.added) else int(PLAIN.fullmatch(t) is None) for t in texts]
        if not any(kinds):
            return self.look_up(*self.plain(texts))
        parts: dict[int, np.ndarray] = {i: np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, self.kind) for i, (t, k) in enumerate(zip(texts, kinds)) if k == 2}
        for kind, cut in enumerate((self.plain, self.other)):
            which = [i for i, k in enumerate(kinds) if k == kind]
            if which:
                ids, sizes = self.look_up(*cut([texts[i] for i in which]))
                parts |= zip(which, np.split(ids, np.cumsum(sizes)[:-1]))
        return np.concatenate([parts[i] for i in range(len(texts))]), np.array([len(parts[i]) for i in range(len(texts))], np.int64)

    def look_up(self, pieces: pa.Array, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each distinct piece is looked up once; what a text has follows from the sizes of its pieces."""
        coded = pieces.dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        number = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))
        if self.known.new:
            self.learn()
        start = np.where(number > 0, self.ends[number - 1], 0)
        size, at = self.ends[number] - start, coded.indices.to_numpy()
        size = size[at]
        before = np.concatenate([[0], np.cumsum(size)])
        ids = self.ids[np.repeat(start[at] - before[:-1], size) + np.arange(before[-1])]
        return ids, np.diff(before[bounds])


class Numbers(dict):
    """Numbers pieces as they come up; ``new`` are those that have no ids yet."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.new.append(piece)
        n = self[piece] = len(self)
        return n


def width(vocabulary: int) -> str:
    """16-bit ids where the vocabulary allows it, to halve what is stored and shuffled."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def known_id() -> Column:
    """The doc_id as it is written."""
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id")


def tokenize(docs: DataFrame, tokenizer_path: str, vocabulary: int, end_id: int = END_ID, text: str = "text", key: list | None = None) -> DataFrame:
    """(key.., ids binary, n_tokens, crc, totals): the ids of every whole text with the end id, the crc that of 32-bit ids.

    The last row of each partition has only ``totals``: how often each id came up in it.
    """
    kind, key = width(vocabulary), key or [known_id()]
    named = small_batches(docs).select(*key, F.coalesce(F.col(text), F.lit("")).alias("_text"))
    keys = [f.name for f in named.schema.fields[:-1]]
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(f"encoder {tokenizer_path} {kind}", lambda: Encoder(tokenizer_path, kind))
        total = np.zeros(vocabulary, "<i8")
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                ids, sizes = encoder.encode(part.column(len(keys)).to_pylist())
                ids, sizes = np.insert(ids, np.cumsum(sizes), end_id), sizes + 1
                total += np.bincount(ids, minlength=vocabulary)
                wide, ends = memoryview(ids.astype("<u4")).cast("B"), np.cumsum(sizes)
                crcs = [zlib.crc32(wide[4 * a : 4 * b]) for a, b in zip((ends - sizes).tolist(), ends.tolist())]
                offsets = (np.concatenate([[0], ends]) * ids.itemsize).astype(np.int32)
                packed = pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(ids)])
                more = [packed, pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64()), pa.nulls(len(sizes), pa.binary())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], *more], names=[*keys, "ids", "n_tokens", "crc", "totals"])
        if total.any():
            last = [pa.nulls(1, f.type) for f in part.schema][: len(keys)] + [pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([total.tobytes()])]
            yield pa.RecordBatch.from_arrays(last, names=[*keys, "ids", "n_tokens", "crc", "totals"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in named.schema.fields[:-1])
    return named.mapInArrow(run, f"{schema}, ids binary, n_tokens long, crc long, totals binary")


# ---------------------------------------------------------------- the code


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` by package-merge; 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    if len(used) > 1 << max_bits:
        raise ValueError(f"{len(used)} ids don't fit in {max_bits} bits")
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) <= 1:
        lengths[used] = 1
        return lengths
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    n = len(order)
    # Each level is the merge of the single ids with the pairs of the level below; what matters of it is which
    # places are single ids, since the cheapest of them are always taken first.
    single, level = [], weights
    for _ in range(max_bits - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(1)
        both = np.concatenate([weights, pairs])
        by = np.argsort(both, kind="stable")
        single.append(by < n)
        level = both[by]
    take = 2 * n - 2
    for is_single in reversed(single):
        k = int(is_single[:take].sum())
        lengths[order[:k]] += 1
        take = 2 * (take - k)
    lengths[order[:take]] += 1
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """The code of each id, first by length and then by id; bits are written from the most significant."""
    codes = np.zeros(len(lengths), np.uint32)
    used = np.flatnonzero(lengths)
    code = last = 0
    for i in used[np.lexsort((used, lengths[used]))].tolist():
        code <<= int(lengths[i]) - last
        last = int(lengths[i])
        codes[i] = code
        code += 1
    return codes


def decode_table(lengths: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """For each value of the next ``max_bits`` bits: the id and the length of its code."""
    ids, bits = np.zeros(1 << max_bits, np.uint32), np.ones(1 << max_bits, np.uint8)
    used = np.flatnonzero(lengths)
    order = used[np.lexsort((used, lengths[used]))]
    spans = 1 << (max_bits - lengths[order].astype(np.int64))
    end = int(spans.sum())
    ids[:end], bits[:end] = np.repeat(order, spans), np.repeat(lengths[order], spans)
    return ids, bits


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray, every: int = CHECKPOINT) -> tuple[bytes, bytes]:
    """The bits of ``ids``, and the bit offset of each ``every``-th id (64-bit)."""
    size = lengths[ids].astype(np.int64)
    at = np.cumsum(size) - size
    total = int(at[-1] + size[-1]) if len(ids) else 0
    # A code of up to 16 bits that starts within a 32-bit word ends in it or in the next one.
    word, shifted = at >> 5, codes[ids].astype(np.uint64) << (64 - (at & 31) - size).astype(np.uint64)
    out = np.zeros(total // 32 + 2, np.uint64)
    if len(ids):
        first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        sums = np.bitwise_or.reduceat(shifted, first)
        out[word[first]] |= sums >> np.uint64(32)
        out[word[first] + 1] |= sums & np.uint64(0xFFFFFFFF)
    return out.astype(">u4").tobytes()[: (total + 7) // 8], at[::every].astype("<u8").tobytes()


def unpack(bits: bytes, offsets: bytes, tokens: int, table: tuple[np.ndarray, np.ndarray], every: int = CHECKPOINT, max_bits: int = MAX_BITS) -> np.ndarray:
    """The ids again: all checkpoints advance together, one table look-up for each id."""
    ids, sizes = table
    at = np.frombuffer(offsets, "<u8").astype(np.int64)
    raw = np.frombuffer(bits + b"\0" * 8, np.uint8).astype(np.uint32)
    window = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    out = np.zeros((len(at), every), np.uint32)
    for k in range(every):
        if k == 1 and tokens == 1:
            break
        v = (window[np.minimum(at >> 3, len(window) - 1)] << (at & 7).astype(np.uint32)) >> np.uint32(32 - max_bits)
        out[:, k] = ids[v]
        at += sizes[v]
    return out.ravel()[:tokens]


# ---------------------------------------------------------------- files


def write_tokens(tokens: DataFrame, path: str, vocabulary: int, shards: int | None = None, order: list | None = None, block_tokens: int = BLOCK_TOKENS, every: int = CHECKPOINT, max_bits: int = MAX_BITS) -> None:
    """Write what ``tokenize`` gives in ascending ``order`` (doc_id, then crc) as coded blocks below ``path``.

    ``shards`` is the number of range partitions; the table is
    cut by ranges of the order, so that a shard never depends on how many rows one source has.
    """
    spark, kind = tokens.sparkSession, width(vocabulary)

    def count(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for part in batch.column(0):
                total += np.frombuffer(part.as_py(), "<i8")
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["token_id", "n"])

    partial = tokens.where("totals is not null").select("totals").mapInArrow(count, "token_id long, n long")
    table = partial.groupBy("token_id").agg(F.sum("n").alias("n")).collect()  # at most the vocabulary
    counts = np.zeros(vocabulary, np.int64)
    for token_id, n in table:
        counts[token_id] = n
    lengths = code_lengths(counts, max_bits)
    used = np.flatnonzero(lengths)
    # From an Arrow table: rows given as a Python list would start a second set of Python workers on the executors.
    spark.createDataFrame(pa.table({"token_id": pa.array(used, pa.int64()), "bits": pa.array(lengths[used], pa.int32())})).coalesce(1).write.parquet(f"{path}/codebook")
    codes = canonical(lengths)
    book = spark.sparkContext.broadcast((codes, lengths))  # two arrays of the vocabulary's length

    def code(batches):
        codes, lengths = book.value
        shard, first, docs, parts, sizes, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block():
            ids = np.frombuffer(b"".join(parts), kind)
            bits, offsets = pack(ids, codes, lengths, every)
            return pa.RecordBatch.from_arrays(
                [pa.array([shard], pa.int32()), pa.array([first], pa.int64()), pa.array([held], pa.int64()), *[pa.array([x], pa.binary()) for x in (np.array(docs, "<i8").tobytes(), np.array(sizes, "<u8").tobytes(), offsets, bits)]],
                names=["shard", "first", "tokens", "doc_ids", "counts", "offsets", "bits"],
            )

        for batch in batches:
            for doc, ids, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                docs.append(doc)
                parts.append(ids.as_py())
                sizes.append(n)
                held += n
                if held >= block_tokens:
                    yield block()
                    first, docs, parts, sizes, held = first + held, [], [], [], 0
        if docs:
            yield block()

    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = order or ["doc_id", "crc"]
    dealt = tokens.where("ids is not null").drop("totals").repartitionByRange(shards, *order).sortWithinPartitions(*order)
    dealt.select("doc_id", "ids", "n_tokens").mapInArrow(code, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")


def read_tokens(spark: SparkSession, path: str, with_ids: bool = False, every: int = CHECKPOINT, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files alone."""
    book = spark.read.schema("token_id long, bits int").parquet(f"{path}/codebook").collect()  # at most the vocabulary
    lengths = np.zeros(max([i for i, _ in book], default=0) + 1, np.uint8)
    for i, bits in book:
        lengths[i] = bits
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    sums = blocks.groupBy("shard").agg(F.sum("tokens").alias("n"))  # one row for each shard
    base = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))

    def decode(batches):
        table = decode_table(lengths, max_bits)
        for batch in batches:
            for row in batch.to_pylist():
                ids = unpack(row["bits"], row["offsets"], row["tokens"], table, every, max_bits).astype("<u4")
                docs, sizes = np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["counts"], "<u8").astype(np.int64)
                ends = np.cumsum(sizes)
                starts = ends - sizes
                raw = memoryview(ids.tobytes())
                cut = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                cols = [pa.array(np.full(len(docs), row["shard"]), pa.int32()), pa.array(docs), pa.array(starts + row["first"]), pa.array(sizes), pa.array([zlib.crc32(x) for x in cut], pa.int64())]
                names = ["shard", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols, names = [*cols, pa.array([bytes(x) for x in cut], pa.binary())], [*names, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=names)

    schema = "shard int, doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    fields = [F.nullif("doc_id", F.lit(NO_ID)).alias("doc_id"), (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"]
    return small_batches(blocks).mapInArrow(decode, schema).join(base, "shard").select(*fields, *["ids"] * with_ids)


def token_binary(docs: DataFrame, path: str, tokenizer_path: str, vocabulary: int, end_id: int = END_ID, key: list | None = None, order: list | None = None) -> DataFrame:
    """Encode, write below ``path`` and read back: see the module for the format and the defined cases.

    ``key`` are the columns that the order needs, doc_id among them; by default doc_id alone.
    """
    held = materialize(tokenize(docs, tokenizer_path, vocabulary, end_id, key=key), "tokens", "zstd")
    write_tokens(held, path, vocabulary, order=order)
    discard(held)
    return read_tokens(docs.sparkSession, path)
