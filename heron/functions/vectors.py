"""Distances and scores of vectors as column expressions; float vectors are computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def _same_size(a: Column, b: Column, value: Column) -> Column:
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors differ in dimensions")).cast("double")).otherwise(value)


def dot(a: Column, b: Column) -> Column:
    return _same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(a, lambda x: x.cast("double") * x.cast("double"))))


def cosine_similarity(a: Column, b: Column) -> Column:
    """0 if a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, F.lit(0.0)).otherwise(dot(a, b) / size)


def cosine_distance(a: Column, b: Column) -> Column:
    return 1 - cosine_similarity(a, b)


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(_same_size(a, b, _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))))


def normalize(a: Column) -> Column:
    """Unit length; a vector of zeros stays."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def distance(metric: str, a: Column, b: Column) -> Column:
    """Smaller is nearer: cosine and euclidean distance, or the negated dot product."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    return {"cosine": cosine_distance, "euclidean": euclidean, "dot": lambda x, y: -dot(x, y)}[metric](a, b)


def to_score(metric: str, d: Column) -> Column:
    """Larger is better: 1 - d, 1 / (1 + d) or -d."""
    return {"cosine": 1 - d, "euclidean": 1 / (1 + d), "dot": -d}[metric]


def score(metric: str, a: Column, b: Column) -> Column:
    return to_score(metric, distance(metric, a, b))
