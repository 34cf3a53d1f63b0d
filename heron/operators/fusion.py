"""Fusion of a vector leg and a keyword leg, each (query_id, id, score). Scores are ordered by PLACES decimals, so that ties don't hang on the order of sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron.operators.keyword import PLACES
from heron.operators.search import ranked


def min_max(leg: DataFrame) -> DataFrame:
    """Scores scaled to 0..1 within each query; where all are equal, 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    return leg.select("query_id", "id", F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low)).alias("scaled"), "score")


def weighted(vector: DataFrame, keyword: DataFrame, k: int = 10, vector_weight: float = 0.7, keyword_weight: float = 0.3, threshold: float | None = None) -> DataFrame:
    """(query_id, rank, id, score, vector_score, keyword_score): weighted sums of scaled scores, 0 for a leg that misses the row."""
    v = min_max(vector).select("query_id", "id", F.col("scaled").alias("v"), F.col("score").alias("vector_score"))
    b = min_max(keyword).select("query_id", "id", F.col("scaled").alias("b"), F.col("score").alias("keyword_score"))
    both = v.join(b, ["query_id", "id"], "full_outer").withColumn("score", F.round(vector_weight * F.coalesce("v", F.lit(0.0)) + keyword_weight * F.coalesce("b", F.lit(0.0)), PLACES))
    both = both if threshold is None else both.where(F.col("score") >= threshold)
    return ranked(both, k, "query_id").select("query_id", "rank", "id", "score", "vector_score", "keyword_score")


def reciprocal_rank(legs: list[DataFrame], k: int = 10, constant: int = 60) -> DataFrame:
    """(query_id, rank, id, score): sums of 1 / (constant + rank) over the legs."""
    ranks = None
    for leg in legs:
        w = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", PLACES)), F.asc("id"))
        part = leg.select("query_id", "id", (1 / (constant + F.row_number().over(w))).alias("part"))
        ranks = part if ranks is None else ranks.unionByName(part)
    summed = ranks.groupBy("query_id", "id").agg(F.round(F.sum("part"), PLACES).alias("score"))
    return ranked(summed, k, "query_id").select("query_id", "rank", "id", "score")


def hybrid(vector: DataFrame, keyword: DataFrame, k: int = 10, how: str = "weighted", **options) -> DataFrame:
    """Each leg is cut to its best 3k rows, then fused: how = weighted or rrf."""
    legs = [ranked(x, 3 * k, "query_id").select("query_id", "id", "score") for x in (vector, keyword)]
    if how not in ("weighted", "rrf"):
        raise ValueError("how must be weighted or rrf")
    return weighted(*legs, k=k, **options) if how == "weighted" else reciprocal_rank(legs, k=k, **options)
