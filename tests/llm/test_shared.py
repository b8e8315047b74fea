import os

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import shared


def test_scratch_is_in_the_named_folder(spark, monkeypatch):
    named = spark.conf.get("spark.checkpoint.dir")
    a, b = (shared.scratch(spark, "x") for _ in range(2))
    assert a != b and a.startswith(f"{named}/loomgrid/x-")
    monkeypatch.setattr(shared, "DIR_KEY", "spark.checkpoint.none")  # no cluster folder: one of the process' own
    c, d = (os.path.dirname(shared.scratch(spark, "x")) for _ in range(2))
    assert c == d and not c.startswith(named)
    monkeypatch.setattr(shared, "MASTER_KEY", "spark.app.name")  # on a cluster that would lose rows
    with pytest.raises(ValueError, match="spark.checkpoint.none"):
        shared.scratch(spark, "x")


def test_written_tables_come_back_and_go(spark):
    df = shared.materialize(spark.range(10).withColumn("x", F.lit(None).cast("string")), "t")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert df.count() == 10 and os.path.isdir(path)
    shared.discard(df)
    assert not os.path.exists(path)
    assert shared.materialize(spark.range(0), "t").count() == 0


def test_each_pair_of_rows_meets_once(spark, monkeypatch):
    rows = spark.range(60).select((F.col("id") % 2).cast("int").alias("k"), F.floor(F.col("id") / 20).cast("int").alias("g"), "id")
    out = shared.tile_pairs(rows, ["k", "g"], "id", [(0,), (1,)], 7, ["g"], carry="k").collect()
    seen = []
    for r in out:
        assert len(r.left) <= 15
        seen += [(min(a, b), max(a, b)) for i, a in enumerate(r.left) for j, b in enumerate(r.right) if not r.same or i < j]
    want = {(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2 and b // 20 - a // 20 <= 1}
    assert len(seen) == len(set(seen)) and set(seen) == want


def test_batches_are_only_ever_lowered(spark):
    before = spark.conf.get(shared.BATCH_KEY)
    try:
        for given, want in (("67108864", str(8 << 20)), ("1000", "1000"), ("64MB", str(8 << 20))):
            spark.conf.set(shared.BATCH_KEY, given)
            shared.small_batches(spark.range(1))
            assert spark.conf.get(shared.BATCH_KEY).rstrip("b") == want
    finally:
        spark.conf.set(shared.BATCH_KEY, before)
