import itertools
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from loomgrid.llm import tokenbin as tb
from loomgrid.llm.shared import scratch

PATH, VOCABULARY = public_tokenizers.path("byte_bpe_50k.json"), 50_257


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)  # as the library has it


def test_pieces_give_the_ids_of_whole_texts(tokenizer):
    rng, encoder = random.Random(0), tb.Encoder(PATH, "<u4")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(50))) for alphabet in ("ab \n\n\t .,é$1'", "ab1 '\n\t .,\x1c\x85 é漢²!", "it's we'll  \r\n x", "aé😀 б1²_") for _ in range(1500)]
    texts += ["", " ", "<|endoftext|> a", "x <|endoftext|>", "é<|endoftext|><|endoftext|>\n b", "<|endoftext |>", "<|endof", "a" * 5000, "x" + " " * 300 + "y"]
    wanted = [e.ids for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    for size in (1, 700, len(texts)):  # and again with pieces that are known
        for i in range(0, 2000 if size == 1 else len(texts), size):
            ids, sizes = encoder.encode(texts[i : i + size])
            ends = np.cumsum(sizes)
            assert [ids[b - n : b].tolist() for b, n in zip(ends, sizes)] == wanted[i : i + size]
    encoder.cache_words = 10
    assert encoder.encode(texts[:5])[0].tolist() == sum(wanted[:5], []) and len(encoder.known) < 100
    assert encoder.encode([""])[1].tolist() == [0]


def cheapest(counts, max_bits):
    """Least total length by trying all Kraft-complete length sets of a small alphabet."""
    best = None
    for lengths in itertools.product(range(1, max_bits + 1), repeat=len(counts)):
        if sum(2.0**-x for x in lengths) <= 1:
            cost = sum(c * x for c, x in zip(counts, lengths))
            best = cost if best is None else min(best, cost)
    return best


def test_code_lengths_are_optimal_and_limited():
    rng = random.Random(1)
    for _ in range(60):
        counts = [rng.choice([1, 2, 3, 10, 100, 1000]) for _ in range(rng.randint(2, 6))]
        for bits in (3, 4):
            lengths = tb.code_lengths(np.array(counts), bits)
            assert (lengths * counts).sum() == cheapest(counts, bits) and lengths.max() <= bits
    assert tb.code_lengths(np.array([0, 0, 0])).tolist() == [0, 0, 0] and tb.code_lengths(np.array([0, 9])).tolist() == [0, 1]
    wide = tb.code_lengths(np.array([2**min(i, 40) for i in range(300)]))
    assert wide.max() == 16 and (2.0 ** -wide.astype(float)).sum() <= 1
    with pytest.raises(ValueError):
        tb.code_lengths(np.ones(9, int), 3)


def test_codes_are_canonical_and_prefix_free():
    lengths = tb.code_lengths(np.array([5, 0, 1, 1, 9, 2, 2, 40]))
    codes = tb.canonical(lengths)
    words = [f"{codes[i]:0{lengths[i]}b}" for i in np.flatnonzero(lengths)]
    assert not any(a != b and b.startswith(a) for a in words for b in words)
    order = sorted(np.flatnonzero(lengths), key=lambda i: (lengths[i], i))
    assert [int(codes[i]) << (16 - int(lengths[i])) for i in order] == sorted(int(codes[i]) << (16 - int(lengths[i])) for i in order)


@pytest.mark.parametrize("n", [0, 1, 2, 127, 128, 129, 5000])
def test_blocks_come_back(n):
    rng = np.random.default_rng(n)
    ids = np.minimum(rng.geometric(0.02, n), 999).astype(np.uint32)
    counts = np.bincount(ids, minlength=1000) + (np.arange(1000) < 3)
    lengths = tb.code_lengths(counts)
    codes, table = tb.canonical(lengths), tb.decode_table(lengths)
    bits, offsets = tb.pack(ids, codes, lengths)
    assert tb.unpack(bits, offsets, n, table).tolist() == ids.tolist()
    text = "".join(f"{codes[i]:0{lengths[i]}b}" for i in ids)
    assert len(bits) == -(-len(text) // 8) and "".join(f"{b:08b}" for b in bits)[: len(text)] == text
    starts = np.frombuffer(offsets, "<u8")
    for k in range(1, len(starts)):  # any checkpoint can be decoded alone
        part = tb.unpack(bits, starts[k : k + 1].tobytes(), min(128, n - 128 * k), table)
        assert part.tolist() == ids[128 * k : 128 * (k + 1)].tolist()


def expected(rows, tokenizer):
    out, at = [], 0
    coded = sorted((tb.NO_ID if r.doc_id is None else r.doc_id, tokenizer.encode(r.text or "", add_special_tokens=False).ids + [2]) for r in rows)
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    for doc, ids in sorted(coded, key=lambda x: (x[0], crc(x[1]))):
        out.append((None if doc == tb.NO_ID else doc, at, len(ids), crc(ids)))
        at += len(ids)
    return out


def test_files_hold_every_document(spark, tokenizer, documents, no_documents, clashing):
    want = expected(documents.collect(), tokenizer)
    for docs in (documents, clashing):
        got = tb.token_binary(docs, scratch(spark, "t"), PATH, VOCABULARY).collect()
        assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == want
    assert tb.token_binary(no_documents, scratch(spark, "t"), PATH, VOCABULARY).count() == 0


def test_null_ids_are_not_minus_one(spark, tokenizer):
    docs = spark.createDataFrame([(None, "a"), (-1, "b c <|endoftext|> d"), (None, "e"), (3, None)], "doc_id long, text string")
    got = tb.token_binary(docs, scratch(spark, "t"), PATH, VOCABULARY).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got), key=lambda r: r[1]) == expected(docs.collect(), tokenizer)
    assert sorted(str(r.doc_id) for r in got) == ["-1", "3", "None", "None"]


def test_small_blocks_and_ids(spark, tokenizer, documents):
    path = scratch(spark, "t")
    tb.write_tokens(tb.tokenize(documents, PATH, VOCABULARY), path, VOCABULARY, shards=5, block_tokens=100)
    rows = tb.read_tokens(spark, path, with_ids=True).collect()
    assert sorted(((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows), key=lambda r: r[1]) == expected(documents.collect(), tokenizer)
    texts = {r.doc_id: r.text for r in documents.collect() if r.text and r.doc_id == 3}
    ids = next(r.ids for r in rows if r.doc_id == 3)
    assert tokenizer.decode(np.frombuffer(bytes(ids), "<u4").tolist()[:-1]) == texts[3]
