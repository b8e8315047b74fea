import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as p
from loomgrid.llm import simhash
from loomgrid.llm.decontam import words_of

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        stage(spark, docs, SF).write.parquet(path)
        out.append(docs)
        docs = spark.read.parquet(path)
    return [*out, docs]


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_all_but_the_last_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:-1])
    assert len(p.STAGES) == 5


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    gone = ids(stages[0]) - ids(stages[1])
    assert len(gone & toxic) >= 0.5 * len(toxic & ids(stages[0]))
    assert len(gone) < 0.3 * stages[0].count()


def test_one_of_each_group_stays(stages):
    of = {r.doc_id: r.component_id for r in simhash.near_components(stages[1]).collect()}
    assert ids(stages[2]) == set(of.values())


def test_leaks_go(spark, stages):
    items = [" ".join(words_of(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holds = {r.doc_id for r in stages[2].collect() if any(f" {i} " in f" {' '.join(words_of(r.text))} " for i in items)}
    assert ids(stages[3]) == ids(stages[2]) - holds


def test_mixture_keeps_all_and_tokens_follow_its_order(spark, stages):
    assert ids(stages[4]) == ids(stages[3])
    order = [r.doc_id for r in stages[4].select("*", "_metadata.file_name", "_metadata.row_index").orderBy("file_name", "row_index").collect()]
    from loomgrid.llm import mixing

    place = {r.doc_id: r.position for r in mixing.mix(stages[3], tie=None).select("row.doc_id", "__position").withColumnRenamed("__position", "position").collect()}
    assert len(place) == len(order)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    at, want = 0, {}
    for d in order:
        tokens = tokenizer.encode(texts[d] or "", add_special_tokens=False).ids + [2]
        want[d] = (at, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        at += len(tokens)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in stages[5].collect()} == want


def test_run_gives_the_same_rows(spark, stages):
    key = lambda df: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert key(p.run(spark, SF)) == key(stages[5])


def tokens_of(texts):
    tokenizer, at, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        want.append((doc, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return want


def test_odd_documents_go_through_all_stages(spark, clashing, tmp_path):
    """Null, empty, very long, repeated and tied rows, null ids, extra columns with the stages' own names, _metadata among them."""
    docs = clashing.withColumns({"_metadata": F.lit("mine"), "part": F.lit(1), "_tile": F.lit(2), "node": F.lit(3)})
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, None, 0), (1, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, docs.where("doc_id = 5").first().text), (2, None), (3, "")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows, out = spark.read.parquet(f"{tmp_path}/documents.parquet"), None
    seen = [rows]
    for i, (name, stage) in enumerate(p.STAGES):
        path = f"{tmp_path}/{name}"
        stage(spark, seen[-1], str(tmp_path)).write.parquet(path)
        out = spark.read.parquet(path)
        assert i == 4 or out.columns == docs.columns
        seen.append(out)
    assert seen[1].count() == docs.count()  # no toxic label to learn from
    near = {r.doc_id: r.component_id for r in simhash.near_components(seen[1]).collect()}
    assert ids(seen[2]) == {c for c in near.values() if c is not None}
    assert ids(seen[2]) - ids(seen[3]) == {5}
    file = seen[4].metadataColumn("_metadata")
    order = [(r.doc_id, r.text) for r in seen[4].select("doc_id", "text", file["file_name"].alias("f"), file["row_index"].alias("i")).orderBy("f", "i").collect()]
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in out.collect()) == sorted(tokens_of(order))
    key = lambda df: sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in df.collect())
    assert key(p.run(spark, str(tmp_path))) == key(out)


def test_empty_tables_go_through_all_stages(spark, no_documents, tmp_path):
    no_documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_files_beyond_five_digits_stay_in_order(spark, tmp_path):
    for number, doc in ((99_999, 3), (100_000, 1), (7, 2)):
        spark.createDataFrame([(doc, f"text {doc}")], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/{number}")
        file = next(f for f in (tmp_path / str(number)).iterdir() if f.name.startswith("part-"))
        (tmp_path / "all").mkdir(exist_ok=True)
        file.rename(tmp_path / "all" / file.name.replace("part-00000", f"part-{number:05d}"))
    got = sorted(p.token_files(spark, spark.read.parquet(f"{tmp_path}/all"), SF).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [2, 3, 1]


def test_tables_not_read_from_files_go_by_doc_id(spark):
    docs = spark.createDataFrame([(2, "b"), (1, "a a")], "doc_id long, text string")
    assert [r.doc_id for r in p.token_files(spark, docs, SF).orderBy("start").collect()] == [1, 2]
