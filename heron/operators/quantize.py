"""Quantization: scalar (8 bits), delta and product codes."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.functions import vectors as V
from heron.operators.ranges import lagged, places, running_vectors


def calibrate(rows: DataFrame, vector_col: str = "vector") -> DataFrame:
    """One row with arrays low and high, the least and greatest value of each dimension. Fewer than two vectors are refused, as they would make one code of everything."""
    spread = rows.where(F.col(vector_col).isNotNull()).select(F.posexplode(vector_col).alias("i", "x")).groupBy("i").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n"))
    ordered = spread.agg(F.array_sort(F.collect_list(F.struct("i", "lo", "hi", "n"))).alias("d"))
    few = F.coalesce(F.array_min(F.col("d")["n"]), F.lit(0)) < 2
    return ordered.select(F.when(few, F.raise_error(F.lit("calibration needs two vectors or more")).cast("array<double>")).otherwise(F.col("d")["lo"].cast("array<double>")).alias("low"), F.col("d")["hi"].cast("array<double>").alias("high"))


def merge_calibrations(a: DataFrame, b: DataFrame) -> DataFrame:
    both = a.unionByName(b).agg(F.collect_list("low").alias("l"), F.collect_list("high").alias("h"))
    least = lambda pick, xs: F.aggregate(F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))), xs[0], lambda p, q: F.zip_with(p, q, lambda x, y: pick(x, y)))
    return both.select(least(F.least, F.col("l")).alias("low"), least(F.greatest, F.col("h")).alias("high"))


def scalar_codes(vector: Column, low: Column, high: Column) -> Column:
    """0..255 for each dimension, halves rounded up, clamped; 128 where a dimension has no range."""
    span = F.zip_with(low, high, lambda a, b: b - a)
    part = F.zip_with(F.zip_with(vector, low, lambda x, a: x.cast("double") - a), span, lambda d, s: F.when(s == 0, F.lit(128.0)).otherwise(F.floor(d / s * 255 + 0.5).cast("double")))
    return F.transform(part, lambda q: F.greatest(F.lit(0), F.least(F.lit(255), q.cast("int"))))


def scalar_vector(codes: Column, low: Column, high: Column) -> Column:
    span = F.zip_with(low, high, lambda a, b: b - a)
    return F.zip_with(F.zip_with(codes, span, lambda q, s: q / F.lit(255.0) * s), low, lambda d, a: d + a)


def step_sample(rows: DataFrame, most: int, order: str = "id") -> DataFrame:
    """The rows at places floor(i * n / most) in the order of a unique column; all rows if they are no more than `most`. Only that column is sorted; rows are read once more for the few that are wanted."""
    placed, n = places(rows, order)
    if n <= most:
        return rows
    i = F.ceil(F.col("place") * F.lit(most) / F.lit(n))
    wanted = placed.where((F.floor(i * F.lit(n) / F.lit(most)) == F.col("place")) & (i < most)).select(order)
    return rows.join(F.broadcast(wanted), order, "left_semi")  # `most` rows


def delta_encode(rows: DataFrame, by: str | None, order: str, vector_col: str = "vector") -> DataFrame:
    """Each vector less the one before it in its group (without by: in the whole table); the first stays. A sequence of any length is dealt into ranges."""
    met, before = lagged(rows, vector_col, "__vector", by, order), F.col("__vector")
    return met.withColumn("delta", F.when(before.isNull(), F.transform(vector_col, lambda x: x.cast("double"))).otherwise(F.zip_with(vector_col, before, lambda x, y: x.cast("double") - y.cast("double")))).drop("__vector")


def delta_decode(rows: DataFrame, by: str | None, order: str, delta_col: str = "delta") -> DataFrame:
    """The vectors again: running sums of each dimension, handed from range to range."""
    return running_vectors(rows, delta_col, by, order)


def delta_codes(rows: DataFrame, by: str, order: str, vector_col: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(by, order, first, codes), and their calibration: deltas in 8 bits, the first vector of each group as it is (codes are null there)."""
    deltas = delta_encode(rows, by, order, vector_col).withColumn("begins", F.row_number().over(Window.partitionBy(by).orderBy(order)) == 1)
    scale = calibrate(deltas.where("NOT begins"), "delta")
    coded = deltas.join(F.broadcast(scale), F.lit(True)).withColumn("codes", F.when(~F.col("begins"), scalar_codes(F.col("delta"), F.col("low"), F.col("high"))))
    return coded.select(by, order, F.when(F.col("begins"), F.col("delta")).alias("first"), "codes"), scale


def delta_vectors(coded: DataFrame, scale: DataFrame, by: str, order: str) -> DataFrame:
    """(by, order, vector) of delta_codes."""
    back = coded.join(F.broadcast(scale), F.lit(True)).withColumn("delta", F.coalesce("first", scalar_vector(F.col("codes"), F.col("low"), F.col("high"))))
    return delta_decode(back, by, order)


def recalibrated(coded: DataFrame, scale: DataFrame) -> tuple[DataFrame, DataFrame]:
    """coded (with codes) coded anew by the calibration of the vectors that its codes stand for, and that calibration."""
    back = coded.join(F.broadcast(scale), F.lit(True)).withColumn("vector", scalar_vector(F.col("codes"), F.col("low"), F.col("high"))).drop("low", "high", "codes")
    new = calibrate(back)
    return back.join(F.broadcast(new), F.lit(True)).withColumn("codes", scalar_codes(F.col("vector"), F.col("low"), F.col("high"))).drop("low", "high", "vector"), new


def compression_stats(rows: DataFrame, vector_col: str = "vector", bytes_each: int = 1) -> DataFrame:
    """n_vectors, original_bytes (4 a value), compressed_bytes, ratio."""
    values = F.sum(F.size(vector_col))
    return rows.where(F.col(vector_col).isNotNull()).agg(F.count("*").alias("n_vectors"), (values * 4).alias("original_bytes"), (values * bytes_each).alias("compressed_bytes")).withColumn("ratio", F.col("original_bytes") / F.col("compressed_bytes"))


def lloyd(x: np.ndarray, k: int, seed: int = 7, rounds: int = 20, move: float = 1e-6) -> np.ndarray:
    """K-means centroids of the rows of x: seeded distinct starts; an empty cluster starts again at a random row."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(x, axis=0)
    c = distinct[rng.permutation(len(distinct))[:k]]
    for _ in range(rounds):
        own = ((c**2).sum(axis=1) - 2 * x @ c.T).argmin(axis=1)
        counts = np.bincount(own, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        new = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(len(x), size=len(c))])
        moved, c = ((new - c) ** 2).sum(axis=1).max(), new
        if moved < move:
            break
    return c


class ProductQuantizer:
    """Codes of m sub-vectors, each the nearest of up to k centroids, fitted to a bounded sample (about `sample` rows): a task for each sub-space."""

    def __init__(self, codebooks: list[np.ndarray]):
        self.codebooks = codebooks

    @classmethod
    def fit(cls, rows: DataFrame, m: int = 8, k: int = 64, vector_col: str = "vector", sample: int = 20_000, seed: int = 7) -> ProductQuantizer:
        size = rows.where(F.col(vector_col).isNotNull()).select(F.size(vector_col)).first()[0]
        if size % m or k > 256:
            raise ValueError("dimensions must be a multiple of m, and k at most 256")
        part, known = size // m, rows.where(F.col(vector_col).isNotNull())
        n = max(1, known.count())
        chosen = known if n <= sample else known.sample(sample / n, seed=seed)
        subs = chosen.select(F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.slice(F.col(vector_col).cast("array<double>"), i * part + 1, part).alias("v")) for i in range(m)])).alias("s")).select("s.*")

        def fitted(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
            book = lloyd(np.stack(group["v"].to_numpy()), k, seed)
            return pd.DataFrame({"i": [key[0]] * len(book), "centroid": list(book)})

        books = subs.groupBy("i").applyInPandas(fitted, "i int, centroid array<double>").collect()  # m * k centroids
        return cls([np.array([r.centroid for r in books if r.i == i]) for i in range(m)])

    def encode(self, vector: Column) -> Column:
        """The centroid numbers of each sub-vector."""
        return self._coded(vector, "array<smallint>", lambda codes: list(codes.astype(np.int16)))

    def pack(self, vector: Column) -> Column:
        """The same as binary, a byte for each."""
        return self._coded(vector, "binary", lambda codes: [x.tobytes() for x in codes.astype(np.uint8)])

    def _coded(self, vector: Column, kind: str, shown: Callable[[np.ndarray], list]) -> Column:
        books = self.codebooks

        @F.pandas_udf(kind)
        def codes(batch: pd.Series) -> pd.Series:
            v, at, out = np.stack(batch.to_numpy()).astype(np.float64), 0, []
            for book in books:
                x = v[:, at : at + book.shape[1]]
                out.append(((book**2).sum(axis=1) - 2 * x @ book.T).argmin(axis=1))
                at += book.shape[1]
            return pd.Series(shown(np.stack(out, axis=1)))

        return codes(vector)

    def decode(self, codes: Column) -> Column:
        books = F.lit([[[float(x) for x in c] for c in book] for book in self.codebooks])
        return F.flatten(F.transform(codes, lambda c, i: F.element_at(F.element_at(books, i + 1), c.cast("int") + 1)))


def inertia(rows: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """(inertia): the sum of the squared distances of all vectors to their nearest centroids."""

    @F.pandas_udf("double")
    def squared(batch: pd.Series) -> pd.Series:
        v = np.stack(batch.to_numpy()).astype(np.float64)
        return pd.Series(np.maximum(((v * v).sum(axis=1)[:, None] + (centroids**2).sum(axis=1) - 2 * v @ centroids.T).min(axis=1), 0))

    return rows.where(F.col(vector_col).isNotNull()).agg(F.sum(squared(F.col(vector_col))).alias("inertia"))
