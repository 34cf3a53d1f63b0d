"""Differential privacy and encryption as column expressions."""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.functions import vectors as V


def gaussian_sigma(epsilon: float, delta: float, sensitivity: float) -> float:
    return sensitivity * math.sqrt(2 * math.log(1.25 / delta)) / epsilon


def laplace_scale(epsilon: float, sensitivity: float) -> float:
    return sensitivity / epsilon


def unit_draw(*parts: Column, seed: int = 7) -> Column:
    """[0, 1) hashed from a key, so that a rerun draws the same; inside (0, 1) at either end."""
    return (F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 52)) + 0.5) / float(1 << 52)


def gaussian(u: Column, v: Column, sigma: float) -> Column:
    """Normal noise from two uniform draws."""
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v) * sigma


def laplace(u: Column, scale: float) -> Column:
    """Laplace noise by the inverse distribution function."""
    x = u - 0.5
    return -scale * F.signum(x) * F.log(1 - 2 * F.abs(x))


def noisy_vector(vector: Column, key: Column, sigma: float | None = None, scale: float | None = None, seed: int = 7) -> Column:
    """The vector with independent noise on each dimension: Gaussian with sigma, or Laplace with scale."""
    if (sigma is None) == (scale is None):
        raise ValueError("give either sigma or scale")

    def each(x: Column, i: Column) -> Column:
        u = unit_draw(key, i, seed=seed)
        return x.cast("double") + (laplace(u, scale) if sigma is None else gaussian(u, unit_draw(key, i, seed=seed + 1), sigma))

    return F.transform(vector, each)


def randomized_response(label: Column, labels: list[str], key: Column, epsilon: float, seed: int = 7) -> Column:
    """The label with probability e^epsilon / (e^epsilon + k - 1), else one of the others."""
    keep = math.exp(epsilon) / (math.exp(epsilon) + len(labels) - 1)
    others = F.filter(F.lit(labels), lambda x: x != label)
    pick = F.element_at(others, (F.floor(unit_draw(key, F.lit("other"), seed=seed) * F.size(others)) + 1).cast("int"))
    return F.when((unit_draw(key, seed=seed) < keep) | (F.size(others) == 0), label).otherwise(pick)


def budgeted(spends: DataFrame, by: str, order: str, epsilon: str, most: float) -> DataFrame:
    """A log of spends with `spent` (running sum) and `allowed`: a spend that reaches or passes the budget is blocked, as is all after it."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return spends.withColumn("spent", F.sum(epsilon).over(w)).withColumn("allowed", F.col("spent") < most)


def sensitivity(vectors: DataFrame, vector_col: str = "vector", tolerance: float = 0.01) -> DataFrame:
    """One row for a calibration set: 2 if all vectors have unit length within the tolerance, else 1.1 times their greatest distance.

    Distances are looked at in blocks (search.farthest), so the set may be large, yet the work grows with its square:
    give a sample, such as step_sample's, of a large table.
    """
    from heron.operators.search import farthest

    off = vectors.agg(F.max(F.abs(V.norm(F.col(vector_col)) - 1)).alias("off")).first().off  # one number
    if off is None or off <= tolerance:
        return vectors.sparkSession.range(1).select(F.lit(2.0).alias("sensitivity"))
    return farthest(vectors, vector_col).select((F.col("distance") * 1.1).alias("sensitivity"))


def derived_key(password: str, salt: bytes, rounds: int = 100_000) -> bytes:
    return hashlib.pbkdf2_hmac("sha256", password.encode(), salt, rounds, 32)


def encrypt(value: Column, key: bytes) -> Column:
    """AES-256-GCM of a string, as Base64; null stays null."""
    return F.base64(F.aes_encrypt(value.cast("binary"), F.lit(key), F.lit("GCM")))


def decrypt(value: Column, key: bytes) -> Column:
    return F.aes_decrypt(F.unbase64(value), F.lit(key), F.lit("GCM")).cast("string")
