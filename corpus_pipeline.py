"""A corpus pipeline over `documents`: language ID, line dedup, near-dedup, mixing to target weights, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from heron.llm import op01_mixing, op06_language_id, op07_packing, op08_line_dedup, op09_near_dedup
from heron.llm.common import remove, shared_dir


# Every stage takes documents whose columns may hold nulls, repeated rows and ids, empty and very long texts, and further
# columns of any names, which all but the last stage return as they are; an empty table gives no rows.


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; those without letters (null and empty texts are) or with an unclear language go. Repeated rows are judged alike."""
    return op06_language_id.accepted(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat, up to two edits, an earlier one; documents that lose every line go. Null texts and rows without id stay; repeated rows keep and lose the same lines."""
    return op08_line_dedup.deduplicated(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group with a Jaccard similarity of 0.8 on 5-word shingles. Null and blank texts, and rows without id, are in no group and stay; repeated rows of an id stay together."""
    return op09_near_dedup.deduplicated(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that sources have their target shares; copies are rows of their own. A null source is one of the rest; rows without id draw by their text, repeated rows alike."""
    return op01_mixing.replicated(docs).select("doc.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens; the token ids of a piece are little-endian 32-bit numbers in ids. A null text is its end id alone; repeated rows are packed each."""
    return op07_packing.packed(docs).withColumnRenamed("id", "doc_id")


STAGES = [("language ID", language), ("line dedup", lines), ("MinHash near-dedup", near_duplicates), ("mixing sources", mixing), ("packing", packing)]

#: Language ID is a trained model, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet in the shared folder and read again as the next one's docs; a stage's rows are removed once the next ones are there."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        if k:
            remove(spark, f"{base}/{k - 1}")
    return docs
