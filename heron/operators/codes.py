"""A stored table of product codes by list, searched by asymmetric distance tables; whole vectors are read for the last few rows only.

    path/codes/cid=<list>/     (id, code, norm): a byte for each sub-vector
    path/vectors/              (id, vector), in ranges of id, so that a few ids touch few row groups
    path/books/                the centroids of lists and sub-spaces
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.functions import vectors as V
from heron.operators import search
from heron.operators.quantize import ProductQuantizer
from heron.operators.search import _matrix, assign, fit_centroids, ranked
from heron.operators.staging import saved, small_side

#: Ids up to which the read of whole vectors gets them as literals, so that the scan skips what has none of them; more are joined.
LITERALS = 20_000


class CodeScores:
    """Scores of queries against coded rows (codes, norms, lists).

    A query's table holds its products with all centroids of each sub-space, so a row's score is m look-ups in it: the
    query is not coded, only rows are. Tables are made for the queries that meet rows at the moment.
    """

    def __init__(self, metric: str, q: np.ndarray, books: list[np.ndarray], centroids: np.ndarray, probes: int | None):
        self.metric, self.q, self.books, self.sizes = metric, q, books, (q**2).sum(axis=1)
        self.cuts = np.cumsum([0, *(b.shape[1] for b in books)])
        self.seen = None
        if probes:
            near = ((centroids**2).sum(axis=1) - 2 * q @ centroids.T).argsort(axis=1)[:, :probes]
            self.seen = np.zeros((len(q), len(centroids)), bool)
            np.put_along_axis(self.seen, near, True, axis=1)

    @staticmethod
    def columns(rows: pa.StructArray | pa.RecordBatch) -> tuple[np.ndarray, ...]:
        code, norm, cid = (rows.field(c) if isinstance(rows, pa.StructArray) else rows[c] for c in ("code", "norm", "cid"))
        return np.frombuffer(b"".join(code.to_pylist()), np.uint8).reshape(len(code), -1), norm.to_numpy().astype(np.float64), cid.to_numpy()

    def rough(self, at: slice, rows: tuple[np.ndarray, ...], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        (codes, norms, cids), q, sizes, cuts = rows, self.q[at], self.sizes[at], self.cuts
        dots = np.zeros((len(q), len(codes)), np.float32)
        for j, book in enumerate(self.books):
            dots += (q[:, cuts[j] : cuts[j + 1]] @ book.T).astype(np.float32).take(codes[:, j], axis=1)
        scores = dots.astype(np.float64)
        if self.metric == "cosine":
            size = np.sqrt(sizes)[:, None] * norms[None, :]
            scores = np.divide(scores, size, out=np.zeros_like(scores), where=size > 0)
        elif self.metric == "euclidean":
            scores = -(sizes[:, None] + norms[None, :] ** 2 - 2 * scores)
        if self.seen is not None:
            scores[~self.seen[at][:, cids]] = -np.inf
        self.last = scores, at.start
        return scores, edges, np.zeros(len(q))

    def exact(self, at: np.ndarray, rows: tuple[np.ndarray, ...], places: np.ndarray) -> np.ndarray:
        return self.last[0][at - self.last[1], places]


def write_codes(rows: DataFrame, path: str, m: int = 32, k: int = 256, lists: int = 16, sample: int = 20_000, id_col: str = "id", vector_col: str = "vector") -> None:
    """Store the codes and vectors of rows. Lists and sub-spaces are fitted to a bounded sample (about `sample` rows); every row with a vector is coded once, here."""
    rows = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    centroids, coder = fit_centroids(rows, lists, sample=sample), ProductQuantizer.fit(rows, m, k, sample=sample)
    books = [(-1, i, [float(x) for x in c]) for i, c in enumerate(centroids)] + [(j, i, [float(x) for x in c]) for j, book in enumerate(coder.codebooks) for i, c in enumerate(book)]
    rows.sparkSession.createDataFrame(books, "part int, at int, centroid array<double>").coalesce(1).write.parquet(f"{path}/books")
    packed = coder.pack(F.col("vector"))
    assign(rows, centroids).select("id", packed.alias("code"), V.norm(F.col("vector")).cast("float").alias("norm"), "cid").repartition("cid").write.partitionBy("cid").parquet(f"{path}/codes")
    rows.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/vectors")


class Codes:
    """The stored codes for reading."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = sorted((r.part, r["at"], r.centroid) for r in spark.read.parquet(f"{path}/books").collect())  # lists and m * k centroids
        parts = sorted({r[0] for r in rows})
        self.centroids, *self.books = [np.array([c for p, _, c in rows if p == part]) for part in parts]
        self.codes, self.vectors = spark.read.parquet(f"{path}/codes"), spark.read.parquet(f"{path}/vectors")

    def candidates(self, queries: DataFrame, n: int, metric: str = "cosine", probes: int | None = None) -> DataFrame:
        """(query_id, id, rough): the n rows with the best scores by their codes, for each of queries (query_id, vector). With probes, a query sees the lists of its nearest centroids only.

        Up to QUERY_BLOCK queries are sent to the tasks; more are dealt into blocks of that size, which meet blocks of
        the codes (see search.met).
        """
        asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        kinds = {"query_id": queries.schema["query_id"].dataType.simpleString(), "id": self.codes.schema["id"].dataType.simpleString()}
        rows, books, centroids = self.codes.select("id", "code", "norm", "cid"), self.books, self.centroids
        few = asked.limit(search.QUERY_BLOCK + 1).toArrow()  # a block of queries at most

        def scores(block: pa.Table) -> CodeScores:
            return CodeScores(metric, _matrix(block["vector"], block.num_rows), books, centroids, probes)

        if few.num_rows > search.QUERY_BLOCK:
            met = search.met(asked.withColumn("part", F.lit(0)), rows.withColumn("part", F.lit(0)), n, scores, lambda batch: CodeScores.columns(batch["row"]), "rough", block=search.QUERY_BLOCK)
            return ranked(met, n, "query_id", score="rough").select("query_id", "id", "rough")
        if probes and few.num_rows:
            near = ((centroids**2).sum(axis=1) - 2 * _matrix(few["vector"], few.num_rows) @ centroids.T).argsort(axis=1)[:, :probes]
            rows = rows.where(F.col("cid").isin(sorted(set(near.ravel().tolist()))))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            if not few.num_rows:
                return
            best = search.Best(few["query_id"].combine_chunks(), scores(few), n)
            for batch in batches:
                if batch.num_rows:
                    best.add(batch.column(0), CodeScores.columns(batch))
            yield from best.found("rough")

        return ranked(rows.mapInArrow(run, f"query_id {kinds['query_id']}, id {kinds['id']}, rough double"), n, "query_id", score="rough").select("query_id", "id", "rough")

    def search(self, queries: DataFrame, k: int = 10, wider: int = 1, metric: str = "cosine", probes: int | None = None, best: DataFrame | None = None) -> DataFrame:
        """(query_id, rank, id, score): of the `wider` * k best rows by their codes, the k best by their vectors. Nothing else of the vectors is read. best: these candidates, if they are there already (saved)."""
        best = saved(self.candidates(queries, wider * k, metric, probes)) if best is None else best
        rows, wanted = self.vectors, best.select("id").distinct()
        few = [r[0] for r in wanted.limit(LITERALS + 1).collect()]
        rows = rows.where(F.col("id").isin(few)) if len(few) <= LITERALS else rows
        whole = rows.join(small_side(best), "id").join(queries.select("query_id", F.col("vector").alias("asked")), "query_id")
        scored = whole.select("query_id", "id", V.score(metric, F.col("vector"), F.col("asked")).alias("score"))
        return ranked(scored, k, "query_id").select("query_id", "rank", "id", "score")
