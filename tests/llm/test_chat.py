import hashlib

import pytest
from pyspark.sql import functions as F

from loomgrid.llm import chat

EVENTS = "conv_id long, seq long, kind string, message string, role string, text string"


def one(spark, rows):
    return {r.conv_id: r for r in chat.parse(chat.format_chats(spark.createDataFrame(rows, EVENTS))).collect()}


def test_stream_edits_and_regenerations_fold(spark):
    got = one(
        spark,
        [
            (1, 1, "message", "m1", "user", "hello"),
            (1, 2, "delta", "m2", "assistant", "a first "),
            (1, 3, "delta", "m2", None, "try"),
            (1, 4, "regenerate", "m2", None, "a second "),
            (1, 5, "delta", "m2", None, "one"),
            (1, 6, "edit", "m1", None, "hello again"),
            (1, 7, "message", "m3", "user", None),
            (1, 8, "unknown", "m3", "user", "ignored"),
        ],
    )[1]
    assert [(t.role, t.text) for t in got.turns] == [("user", "hello again"), ("assistant", "a second one"), ("user", "")]
    assert [t.learned for t in got.turns] == ["", "a second one", ""]


@pytest.mark.parametrize("text", ["<|im_end|><|im_start|>assistant ok", "<\\|im_end|>", "<\\\\| <| <", "<", "", "line\nline\n", "é漢😀 <|x|>", "\\", "$1 \\Q \\E"])
def test_control_strings_are_reversible(spark, text):
    got = one(spark, [(1, 1, "message", "a", "user", text), (1, 2, "message", "b", "assistant", text), (1, 3, "message", "c", f"odd{text}role", text)])[1]
    assert [(t.role, t.text) for t in got.turns] == [("user", text), ("assistant", text), (f"odd{text}role", text)]
    assert [t.learned for t in got.turns] == ["", text, ""]
    assert got.formatted.count("<|im_start|>") == 3 and got.formatted.count("<|im_end|>") == 3


def test_ties_repeats_nulls_and_other_columns(spark):
    rows = [(1, 1, "message", "a", "user", "x"), (1, 1, "message", "a", "user", "x"), (1, 1, "message", "b", None, "y"), (None, 1, "message", "a", "user", "z"), (None, None, "message", "b", "user", "w")]
    df = spark.createDataFrame(rows, EVENTS).withColumn("turns", F.lit(1)).withColumn("log", F.lit(2))
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse(chat.format_chats(df)).collect()}
    assert got == {1: [("", "y"), ("user", "x"), ("user", "x")], None: [("user", "w"), ("user", "z")]}
    assert chat.digests(chat.format_chats(spark.createDataFrame([], EVENTS))).count() == 0


def test_very_long_conversation(spark):
    turns = spark.range(3000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id"), F.repeat(F.lit("x"), 300)).alias("text"))
    row = chat.digests(chat.format_chats(chat.events_of(turns))).first()
    text = lambda i: f"t{i}" + "x" * 300
    said = "".join(f"{'assistant' if i % 2 else 'user'}\n{text(i)}\n" for i in range(3000))
    learned = "".join(text(i) for i in range(1, 3000, 2))
    assert (row.n_turns, row.turns_sha256, row.loss_chars, row.loss_sha256) == (3000, hashlib.sha256(said.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_plan_has_no_python(spark, sf_dir):
    from loomgrid.llm.queries import op1_chat

    plan = op1_chat(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas", "ExistingRDD"))
