import random

import pytest

WORDS = "the of and river stone quiet morning ledger copper window harvest signal north garden paper engine winter silver bridge market".split()


@pytest.fixture(scope="session")
def prose():
    rng = random.Random(5)
    return lambda n, seed=None: " ".join((random.Random(seed) if seed is not None else rng).choice(WORDS) + str((random.Random(seed * 31 + i) if seed is not None else rng).randrange(40)) for i in range(n))


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark, prose):
    """A small table with every odd case: null, empty, very long, repeated and tied rows, nulls in any column."""
    base = [prose(60) for _ in range(12)]
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in enumerate(base)]
    rows += [(20, base[0], "en", "s0", 1), (21, base[0] + " end", "en", "s0", 1), (22, None, "en", "s1", None), (23, "", None, None, 0), (24, "  \t\n", "en", "s1", 4)]
    rows += [(25, prose(30_000), "en", "s2", 1), (26, "word", "en", "s2", 4), (26, "word", "en", "s2", 4), (None, base[3], None, "s2", None), (27, "1234 !!! 99", "en", "s0", 9)]
    return spark.createDataFrame(rows, DOCUMENTS).repartition(3)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def clashing(documents):
    """The same with extra columns that carry the operators' own names."""
    from pyspark.sql import functions as F

    names = "row fp _kept _alike _text ids crc __source __hash __position __block score predicted lang_pred component_id _label file".split()
    return documents.withColumns({n: F.lit(f"extra {n}") for n in names})
