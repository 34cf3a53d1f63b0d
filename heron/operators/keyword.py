"""Keyword search in documents that have no stored index: postings, BM25 over them, and their statistics. operators.segments stores an index and maintains it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.functions.text import tokens
from heron.operators.search import ranked
from heron.operators.staging import saved, small_side, spread

K1, B = 1.2, 0.75
#: Folders of a stored index, by a hash of the term; more for larger ones.
BUCKETS = 32
#: Decimals of a score: sums of doubles depend on their order beyond that, and ties must not.
PLACES = 9


@dataclass
class Index:
    """postings (bucket, term, id, tf, dl) and lengths (id, dl), a row for each document, also one without terms."""

    postings: DataFrame
    lengths: DataFrame

    def frequencies(self) -> DataFrame:
        """(bucket, term, df): the documents that have a term."""
        return self.postings.groupBy("bucket", "term").agg(F.count("*").alias("df"))


def built(docs: DataFrame, id_col: str = "id", text_col: str = "text", tokenize=tokens, buckets: int = BUCKETS) -> Index:
    """The index of docs, computed when it is used; a null text has no terms. Ids name documents: give each once."""
    words = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))).select("id", tokenize(F.col("text")).alias("terms"))
    exploded = words.select("id", F.size("terms").alias("dl"), F.explode("terms").alias("term"))
    counted = exploded.groupBy("id", "dl", "term").agg(F.count("*").alias("tf"))
    return Index(counted.select(F.pmod(F.hash("term"), F.lit(buckets)).alias("bucket"), "term", "id", "tf", "dl"), words.select("id", F.size("terms").alias("dl")))


def corpus_stats(index: Index) -> DataFrame:
    """One row: n_docs, avg_dl, vocabulary."""
    sizes = index.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    return sizes.join(F.broadcast(index.frequencies().agg(F.count("*").alias("vocabulary"))), F.lit(True))


def weight(tf: Column, dl: Column, df: Column, n_docs: Column, avg_dl: Column, k1: float = K1, b: float = B) -> Column:
    idf = F.log((n_docs - df + 0.5) / (df + 0.5) + 1)
    return idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avg_dl))


def search(index: Index, queries: DataFrame, k: int | None = 10, tokenize=tokens, k1: float = K1, b: float = B, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, rank, id, score) of the k best documents for each of queries (query_id, text); without k, all matches.

    A term counts as often as the query has it. Scores have PLACES decimals; ties go to the smaller id.
    """
    asked = queries.select("query_id", F.explode(tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    asked = saved(asked.withColumn("bucket", F.pmod(F.hash("term"), F.lit(buckets))))
    terms = small_side(asked.select("bucket", "term").distinct())
    factors = small_side(asked.join(index.frequencies().join(terms, ["bucket", "term"], "left_semi"), ["bucket", "term"]))
    sizes = index.lengths.agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avg_dl"))
    scored = index.postings.join(factors, ["bucket", "term"]).join(F.broadcast(sizes), F.lit(True))
    scored = scored.withColumn("part", F.col("times") * weight(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avg_dl"), k1, b))
    found = scored.groupBy("query_id", "id").agg(F.round(F.sum("part"), PLACES).alias("score")).where("score > 0")
    return found if k is None else ranked(found, k, "query_id").select("query_id", "rank", "id", "score")


def bm25(docs: DataFrame, queries: DataFrame, k: int | None = 10, id_col: str = "id", text_col: str = "text", tokenize=tokens, k1: float = K1, b: float = B) -> DataFrame:
    """search() in documents that have no stored index."""
    return search(built(docs, id_col, text_col, tokenize), queries, k, tokenize, k1, b)
