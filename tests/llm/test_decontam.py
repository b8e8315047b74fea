import random

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import decontam as d


def distance(pattern, text):
    """Plain dynamic programming: least distance to any stretch, and where the first ends."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, t in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != t)))
        row = new
    return min(row), row.index(min(row))


def test_myers_is_exact():
    rng = random.Random(1)
    for _ in range(2000):
        p, t = ([rng.choice("abcd") for _ in range(rng.randint(low, high))] for low, high in ((1, 90), (0, 25)))
        assert d.myers(p, t) == distance(p, t)


def test_matcher_misses_nothing():
    rng = random.Random(2)
    words = ["the", "of", "in", "x", "y", "z"]
    for _ in range(800):
        items = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))) for i in range(4)]
        text = " ".join(rng.choice(words) for _ in range(rng.randint(0, 60)))
        want = {(i, distance(t.split(), text.split())[0]) for i, t in items if distance(t.split(), text.split())[0] <= len(t.split()) // 5}
        assert {(i, e) for i, e, _, _ in d.Matcher(items).find(text)} == want
        long = {i for i, t in items if len(t.split()) >= 5}
        assert {(i, e) for i, e, _, _ in d.Matcher(items, min_words=5).find(text)} == {(i, e) for i, e in want if i in long}


def test_scripts_without_spaces_are_matched_by_characters():
    han, thai = "今天天气很好我们去公园散步吧", "สวัสดีชาวโลกวันนี้อากาศดี"
    assert d.words_of("東京 Tower99 カ_x") == ["東", "京", "tower99", "カ", "_x"]
    found = lambda item, text: [(i, e) for i, e, _, _ in d.Matcher([(1, item)]).find(text)]
    assert found(han, f"前言{han}后记") == [(1, 0)] and found(han, f"前言{han[:5]}X{han[6:]}后记") == [(1, 1)] and found(han, "今天天气不好") == []
    assert found(thai, f"abc{thai}") == [(1, 0)]
    assert found("two words", "here are two words") == [(1, 0)] and found("two words", "two other words") == []


@pytest.fixture(scope="module")
def benchmark(spark, prose):
    return spark.createDataFrame([(1, prose(40, 1)), (2, prose(25, 2)), (2, prose(25, 2)), (3, None), (4, ""), (5, "the"), (None, prose(20, 3))], "item_id long, text string")


def edited(text, every):
    return " ".join("CHANGED" if i % every == 0 else w.upper() + "," for i, w in enumerate(text.split(), 1))


def test_leaks_and_clean_documents(spark, prose, benchmark, documents):
    rows = [(1, "intro " + prose(40, 1) + " outro"), (2, edited(prose(40, 1), 7)), (3, edited(prose(40, 1), 3)), (4, prose(200)), (5, prose(20, 3) + " " + prose(25, 2)), (6, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): r for r in d.leaks(docs, benchmark).collect()}
    assert set(found) == {(1, 1), (2, 1), (5, None), (5, 2)}
    assert found[1, 1].edits == 0 and found[1, 1].last_word == 40 and found[2, 1].edits == 5
    assert d.leaks(docs, benchmark).count() == 5  # the repeated item twice
    assert sorted(r.doc_id for r in d.decontaminate(docs, benchmark).collect()) == [3, 4, 6, 7]
    small = d.leaks(docs, benchmark, block_chars=10)  # one block for each item
    assert {(r.doc_id, r.item_id) for r in small.collect()} == set(found)
    assert d.decontaminate(documents, benchmark).count() == documents.count()


def test_empty_tables_and_clashing_names(spark, benchmark, documents, no_documents, clashing):
    assert d.leaks(no_documents, benchmark).count() == 0
    assert d.leaks(documents, benchmark.limit(0)).count() == 0
    names = "doc_id edits item_words last_word lang row".split()
    named = benchmark.withColumns({n: F.lit("extra") for n in names})
    both = clashing.withColumns({n: F.lit("extra") for n in ("item_id", "edits", "item_words", "last_word")})
    one = benchmark.limit(0).union(documents.where("doc_id = 4").select("doc_id", "text")).withColumn("edits", F.lit(7))
    assert [(r.doc_id, r.item_id, r.edits) for r in d.leaks(both, one).collect()] == [(4, 4, 0)]
    kept = d.decontaminate(clashing, named)
    assert kept.columns == clashing.columns and kept.count() == clashing.count()
    assert d.decontaminate(documents, benchmark.limit(0)).count() == documents.count()
