"""From raw documents to token files, in five stages that each call one operator of ``loomgrid.llm``.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's docs. All but the last return the columns of documents.

1. toxicity: documents scored 0.5 or more go. Learns from a bounded sample of the labelled rows.
2. simhash: one document of each group of near copies (Jaccard similarity of five-word shingles of 0.8 or more) stays, that
   of the smallest doc_id: SimHash fingerprints find the pairs, the sets of shingles verify them.
3. decontaminate: documents that hold a benchmark item within its error budget go.
4. mixing: every document gets its place in the weighted mixture, and the rows are written in that order.
5. tokens: ids of every document, coded, written in the order of the mixture and read back.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgrid.llm import decontam, mixing, simhash, tokenbin, toxicity
from loomgrid.llm.queries import TOKENIZER, VOCABULARY, table
from loomgrid.llm.shared import delete, scratch, swept


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def near_copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.keep_one(docs)


def leaks_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.in_order(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents read from files are taken in the order in which they were written, others by doc_id.

    The order is that of the numbers in the files' names (part, and file of the part), then that of the rows in a file.
    """
    key, order = [tokenbin.known_id()], None
    try:
        file = docs.metadataColumn("_metadata")
        docs = docs.select("doc_id", "text", file["file_name"].alias("file"), file["row_index"].alias("row"))
        number = lambda pattern: F.expr(f"try_cast(regexp_extract(file, '{pattern}', 1) as long)")
        order = ["part", "in_part", "file", "row"]
        key += [number("^part-([0-9]+)").alias("part"), number("-c([0-9]+)[.]").alias("in_part"), F.col("file"), F.col("row")]
    except AnalysisException:  # no file metadata: the table isn't read from files
        pass
    return tokenbin.token_binary(docs, scratch(spark, "token-files"), public_tokenizers.path(TOKENIZER), VOCABULARY, key=key, order=order)


STAGES = [("toxicity", toxic_out), ("simhash", near_copies_out), ("decontaminate", leaks_out), ("mixing", mixture), ("tokens", token_files)]

#: The tokenizer, the learned weights and the fingerprints can't be expressed in SQL: tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's scratch tables and its predecessor's rows are deleted once its own rows are written."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = scratch(spark, f"stage-{name}")
        with swept(spark, [path]):
            stage(spark, docs, sf_dir).write.parquet(path)
        if last:
            delete(spark, last)
        docs, last = spark.read.parquet(path), path
    return STAGES[-1][1](spark, docs, sf_dir)
