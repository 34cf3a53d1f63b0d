"""Vector search: exact top-k for one query or a set of queries, and an inverted file of centroids for approximate search."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.functions import vectors as V
from heron.operators.staging import saved

#: Queries that the driver sends to the tasks; more are dealt into blocks of BLOCKS times as many. Rows of a block, at least.
QUERY_BLOCK, BLOCKS, ROW_BLOCK = 4096, 8, 1 << 14
#: Scores that a task holds at once, and queries whose best rows are merged at once.
SCORES, MERGED = 1 << 20, 256


def ranked(df: DataFrame, k: int, *by: str, score: str = "score", key: str = "id") -> DataFrame:
    """The k best rows of each group with their rank from 1; ties go to the smaller key."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), F.asc(key))
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(rows: DataFrame, query: list[float], k: int = 10, metric: str = "cosine", where: Column | None = None, threshold: float | None = None, id_col: str = "id", vector_col: str = "vector", include_vectors: bool = False) -> DataFrame:
    """(id, score[, vector]) of the k best rows for one query vector.

    The filter comes first, so it is pushed to the scan and never leaves fewer than k rows by accident; sorting and
    cutting are one step (TakeOrderedAndProject). Rows without a vector have no score and are left out.
    """
    rows = rows if where is None else rows.where(where)
    s = V.score(metric, F.col(vector_col), F.lit([float(x) for x in query]))
    out = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), s.alias("score"), *([F.col(vector_col).alias("vector")] if include_vectors else []))
    out = out if threshold is None else out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), F.asc("id")).limit(k)


class VectorScores:
    """Scores of queries against rows (vectors, squared norms): rough ones of all pairs by a matrix product, and those of single pairs, which don't hang on a row's place in its batch."""

    def __init__(self, metric: str, q: np.ndarray):
        self.metric, self.q, self.sizes = metric, q, (q * q).sum(axis=1)

    @staticmethod
    def columns(v: np.ndarray) -> tuple[np.ndarray, ...]:
        return v, (v * v).sum(axis=1)

    def rough(self, at: slice, rows: tuple[np.ndarray, ...], edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers that rise with the scores, the least of them that a score from `edges` on may have, and their possible error."""
        (v, sizes), q, own = rows, self.q[at], self.sizes[at]
        dots = q @ v.T
        if self.metric == "cosine":
            dots *= np.divide(1, np.sqrt(own), out=np.zeros_like(own), where=own > 0)[:, None]
            dots *= np.divide(1, np.sqrt(sizes), out=np.zeros_like(sizes), where=sizes > 0)[None, :]
            return dots, edges, np.full(len(q), 1e-9)
        if self.metric == "dot":
            return dots, edges, 1e-9 * np.sqrt(own * sizes.max())
        dots *= 2
        dots -= own[:, None]
        dots -= sizes[None, :]
        far = np.divide(1, edges * (1 - 1e-12), out=np.full_like(edges, np.inf), where=edges > 0) - 1
        return dots, -(far**2), 1e-9 * (own + sizes.max())

    def exact(self, at: np.ndarray, rows: tuple[np.ndarray, ...], places: np.ndarray) -> np.ndarray:
        out = np.empty(len(at))
        for i in range(0, len(at), 1 << 14):
            q, v, own, sizes = self.q[x := at[i : i + (1 << 14)]], rows[0][y := places[i : i + (1 << 14)]], self.sizes[x], rows[1][y]
            if self.metric == "euclidean":
                out[i : i + len(x)] = 1 / (1 + np.sqrt(((q - v) ** 2).sum(axis=1)))
                continue
            dots = (q * v).sum(axis=1)
            size = np.sqrt(own) * np.sqrt(sizes)
            out[i : i + len(x)] = dots if self.metric == "dot" else np.divide(dots, size, out=np.zeros_like(dots), where=size > 0)
        return out


class Best:
    """The k best rows so far of each of a task's queries, by score and then the smaller id; rows come in batches of any number and size.

    Scores are made for MERGED queries and SCORES / MERGED rows at once, so the memory of a task follows its queries and
    k, but neither its rows nor their ties.
    """

    def __init__(self, query_ids: pa.Array, scores, k: int, threshold: float | None = None):
        self.query_ids, self.scores, self.k = query_ids, scores, k
        self.edges = np.full(len(query_ids), -np.inf if threshold is None else threshold, np.float64)
        self.kept: dict[int, pa.Table] = {}

    def add(self, ids: pa.Array, columns: tuple[np.ndarray, ...]) -> None:
        step = max(1, SCORES // MERGED)
        for j in range(0, len(ids), step):
            for i in range(0, len(self.query_ids), MERGED):
                self._meet(i, ids.slice(j, step), tuple(c[j : j + step] for c in columns))

    def _meet(self, i: int, ids: pa.Array, rows: tuple[np.ndarray, ...]) -> None:
        edges = self.edges[i : i + MERGED]
        s, least, slack = self.scores.rough(slice(i, i + MERGED), rows, edges)
        found = s >= (least - slack)[:, None]
        if np.count_nonzero(found) > 4 * self.k * len(edges) and self.k < s.shape[1]:
            cut = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
            found &= s >= (cut - 2 * slack)[:, None]
        at, places = np.nonzero(found & (s > -np.inf))
        if not len(at):
            return
        scores = self.scores.exact(at + i, rows, places)
        keep = scores >= edges[at]
        new = pa.table({"at": pa.array(at[keep]), "score": pa.array(scores[keep]), "id": ids.take(pa.array(places[keep]))})
        both = pa.concat_tables([self.kept[i], new]) if i in self.kept else new
        both = both.take(pc.sort_indices(both, sort_keys=[("at", "ascending"), ("score", "descending"), ("id", "ascending")])).combine_chunks()
        at = both["at"].to_numpy()
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        last = rank == self.k - 1
        edges[at[last]] = both["score"].to_numpy()[last]
        self.kept[i] = both.filter(pa.array(rank < self.k))

    def found(self, score: str = "score") -> Iterator[pa.RecordBatch]:
        for i, rows in self.kept.items():
            if rows.num_rows:
                whole = rows.combine_chunks().to_batches()[0]
                yield pa.RecordBatch.from_arrays([self.query_ids.take(pc.add(whole["at"], i)), whole["id"], whole["score"]], names=["query_id", "id", score])


def _matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = pc.list_flatten(column)
    return np.asarray(flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat, np.float64).reshape(n, -1)


def batch_top_k(rows: DataFrame, queries: DataFrame, k: int = 10, metric: str = "cosine", threshold: float | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """(query_id, rank, id, score): the k best rows for each of `queries` (query_id, vector).

    Up to QUERY_BLOCK queries are sent to the tasks, where they meet the vectors batch by batch in a matrix product; a
    task keeps only the k best of each query, a window merges those of the tasks, and vectors are never shuffled. More
    queries never pass through the driver: see met.
    """
    if metric not in V.METRICS:
        raise ValueError(f"metric must be one of {V.METRICS}")
    id_kind, query_kind = rows.select(id_col).schema[0].dataType.simpleString(), queries.select("query_id").schema[0].dataType.simpleString()
    slim = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    few = asked.limit(QUERY_BLOCK + 1).toArrow()  # a block of queries at most
    if few.num_rows > QUERY_BLOCK:
        met_rows = _vectors_met(asked.withColumn("part", F.lit(0)), slim.withColumn("part", F.lit(0)), k, metric, threshold)
        return ranked(met_rows, k, "query_id").select("query_id", "rank", "id", "score")
    ids, q = few["query_id"].combine_chunks(), _matrix(few["vector"], few.num_rows) if few.num_rows else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if q is None:
            return
        best = Best(ids, VectorScores(metric, q), k, threshold)
        for b in batches:
            if b.num_rows:
                best.add(b.column(0), VectorScores.columns(_matrix(b.column(1), b.num_rows)))
        yield from best.found()

    return ranked(slim.mapInArrow(run, f"query_id {query_kind}, id {id_kind}, score double"), k, "query_id").select("query_id", "rank", "id", "score")


def _vectors_met(queries: DataFrame, rows: DataFrame, k: int, metric: str, threshold: float | None = None) -> DataFrame:
    """met() by whole vectors: queries (part, query_id, vector), rows (part, id, vector)."""

    def scores(asked: pa.Table) -> VectorScores:
        return VectorScores(metric, _matrix(asked["vector"], asked.num_rows))

    def columns(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        return VectorScores.columns(_matrix(batch["row"].field("vector"), batch.num_rows))

    return met(queries, rows, k, scores, columns, threshold=threshold)


def met(queries: DataFrame, rows: DataFrame, k: int, scores: Callable[[pa.Table], object], columns: Callable[[pa.RecordBatch], tuple[np.ndarray, ...]], score: str = "score", threshold: float | None = None, block: int | None = None) -> DataFrame:
    """(query_id, id, score): candidates for the k best rows of the same `part` (an integer) for each query, the k best of each unit of work.

    queries (part, query_id, ...) are dealt into blocks (of `block`, or BLOCKS * QUERY_BLOCK), the rows (part, id, ...)
    of a part into as many blocks as keep all cores busy. A unit is a pair of blocks: its queries come first and are
    held, its rows stream past them (see Best). scores(queries of a unit) gives what rates them, columns(batch) what it
    needs of rows.
    """
    query_kind, kind = queries.schema["query_id"].dataType.simpleString(), rows.schema["id"].dataType.simpleString()
    block, cores = block or BLOCKS * QUERY_BLOCK, rows.sparkSession.sparkContext.defaultParallelism
    n_queries, n_rows = (dict(df.groupBy("part").count().collect()) for df in (queries, rows))  # a row for each part
    total, first, xs, ys = max(1, sum(n_rows.values())), {}, {}, {}
    n_units = 0
    for part in sorted(n_queries.keys() & n_rows.keys()):
        xs[part] = -(-n_queries[part] // block)
        ys[part] = min(-(-n_rows[part] // ROW_BLOCK), max(1, round(2 * cores * n_rows[part] / total)))
        first[part], n_units = n_units, n_units + xs[part] * ys[part]
    if not n_units:
        return rows.sparkSession.createDataFrame([], f"query_id {query_kind}, id {kind}, {score} double")
    of = lambda by: F.create_map(*(F.lit(z).cast("int") for pair in by.items() for z in pair))[F.col("part")]
    home = lambda c, n: F.pmod(F.xxhash64(c, F.lit(29)), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    whole = lambda df: F.struct(*[c for c in df.columns if c != "part"])
    none = lambda df: F.lit(None).cast(df.select(whole(df)).schema[0].dataType)
    known = F.col("part").isin(list(first))
    left = queries.where(known).select("part", home("query_id", of(xs)).alias("x"), every(of(ys)).alias("y"), F.lit(False).alias("is_row"), whole(queries).alias("query"), none(rows).alias("row"))
    right = rows.where(known).select("part", every(of(xs)).alias("x"), home("id", of(ys)).alias("y"), F.lit(True).alias("is_row"), none(queries).alias("query"), whole(rows).alias("row"))
    units = left.unionByName(right).select((of(first) + F.col("x") * of(ys) + F.col("y")).cast("int").alias("unit"), "is_row", "query", "row")
    units = units.repartitionById(n_units, F.col("unit")).sortWithinPartitions("unit", "is_row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked: list[pa.RecordBatch] = []
        best, unit = None, None
        for batch in batches:
            key = batch["unit"].to_numpy().astype(np.int64) * 2 + batch["is_row"].to_numpy(zero_copy_only=False)
            edges = [0, *(np.flatnonzero(np.diff(key)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges, edges[1:]):
                if lo == hi:
                    continue
                if key[lo] // 2 != unit:
                    yield from best.found(score) if best else ()
                    asked, best, unit = [], None, key[lo] // 2
                part = batch.slice(lo, hi - lo)
                if key[lo] % 2 == 0:
                    asked.append(pa.RecordBatch.from_struct_array(pc.take(part["query"], pa.array(np.arange(hi - lo)))))
                elif asked or best:
                    if best is None:
                        held = pa.Table.from_batches(asked).combine_chunks()
                        best, asked = Best(held["query_id"].combine_chunks(), scores(held), k, threshold), []
                    part = part.take(pa.array(np.arange(hi - lo)))
                    best.add(part["row"].field("id"), columns(part))
        yield from best.found(score) if best else ()

    return units.mapInArrow(run, f"query_id {query_kind}, id {kind}, {score} double")


def similar_pairs(rows: DataFrame, threshold: float, id_col: str = "id", vector_col: str = "vector", block: int = 2048) -> DataFrame:
    """(a, b, score), a < b: all pairs with a cosine of at least `threshold`, for tables up to some millions of vectors.

    Vectors are dealt into blocks by a hash of their ids; each pair of blocks is a unit of work, a matrix product of
    which only the pairs found leave the task. A row is sent once for each block, not for each row.
    """
    kind = rows.schema[id_col].dataType.simpleString()
    known = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    n = max(1, -(-known.count() // block))
    own = F.pmod(F.xxhash64("id", F.lit(23)), F.lit(n)).cast("int")
    dealt = known.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    units = dealt.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "id", "v").repartition("x", "y").sortWithinPartitions("x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, parts = None, []

        def found() -> Iterator[pa.RecordBatch]:
            both = pa.Table.from_batches(parts)
            v = np.asarray(pc.list_flatten(both["v"]).combine_chunks(), np.float64).reshape(both.num_rows, -1)
            v /= np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)
            home = both["own"].to_numpy()
            a, b = np.flatnonzero(home == unit[0]), np.flatnonzero(home == unit[1])
            for i in range(0, len(a), block):  # a block may have some more rows than the mean
                s = v[a[i : i + block]] @ v[b].T
                p, q = np.nonzero(s >= threshold)
                ids = both["id"]
                left, right = ids.take(pa.array(a[i + p])), ids.take(pa.array(b[q]))
                keep = pc.less(left, right) if unit[0] == unit[1] else pc.not_equal(left, right)
                swap = pc.greater(left, right)
                out = pa.table({"a": pc.if_else(swap, right, left), "b": pc.if_else(swap, left, right), "score": pa.array(s[p, q])}).filter(keep)
                yield from out.combine_chunks().to_batches()

        for batch in batches:
            x, y = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero((np.diff(x) != 0) | (np.diff(y) != 0)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if lo == hi:
                    continue
                if unit is not None and unit != (x[lo], y[lo]):
                    yield from found()
                    parts = []
                unit = (x[lo], y[lo])
                parts.append(batch.slice(lo, hi - lo).select(["own", "id", "v"]))
        if parts:
            yield from found()

    return units.mapInArrow(run, f"a {kind}, b {kind}, score double")


def farthest(rows: DataFrame, vector_col: str = "vector", block: int = 2048) -> DataFrame:
    """(distance): the greatest Euclidean distance of two vectors, by blocks that meet in matrix products; 0 for one vector."""
    known = rows.where(F.col(vector_col).isNotNull()).select(F.col(vector_col).cast("array<double>").alias("v"))
    n = max(1, -(-known.count() // block))
    dealt = known.withColumn("own", F.pmod(F.xxhash64("v"), F.lit(n)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    units = dealt.select(F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "v")

    def greatest(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        v, home = np.stack(group["v"].to_numpy()), group["own"].to_numpy()
        a, b, most = v[home == key[0]], v[home == key[1]], 0.0
        for i in range(0, len(a), block):
            part = a[i : i + block]
            if len(b):
                most = max(most, float(((part * part).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * part @ b.T).max()))
        return pd.DataFrame({"squared": [most]})

    return units.groupBy("x", "y").applyInPandas(greatest, "squared double").agg(F.sqrt(F.greatest(F.coalesce(F.max("squared"), F.lit(0.0)), F.lit(0.0))).alias("distance"))


def semantic_search(rows: DataFrame, queries: DataFrame, embedder=None, k: int = 10, where: Column | None = None, threshold: float | None = None, text_col: str | None = None, **options) -> DataFrame:
    """(query_id, rank, id, score[, text]) for queries (query_id, text): each is embedded, then compared with the rows that pass the filter."""
    from heron.functions.models import embed

    asked = queries.select("query_id", (embedder or embed())(F.col("text")).alias("vector"))
    kept = rows if where is None else rows.where(where)
    found = batch_top_k(kept, asked, k, threshold=threshold, **options)
    return found if text_col is None else found.join(kept.select(F.col(options.get("id_col", "id")).alias("id"), F.col(text_col).alias("text")), "id").select("query_id", "rank", "id", "score", "text")


def search_stream(queries: DataFrame, rows: DataFrame, path: str, checkpoint: str, **options):
    """Answers a stream of queries (query_id, text): each micro-batch is searched in `rows` and written to a folder of its own, which a rerun writes anew."""

    def answer(batch: DataFrame, number: int) -> None:
        semantic_search(rows, batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return queries.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ---- inverted file -------------------------------------------------------------------------------------------------


def fit_centroids(rows: DataFrame, lists: int, vector_col: str = "vector", sample: int | None = 50_000, seed: int = 7) -> np.ndarray:
    """Centroids of a bounded sample (about `sample` rows; None: of all rows), by Spark's k-means."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    chosen = rows.where(F.col(vector_col).isNotNull()).select(array_to_vector(F.col(vector_col).cast("array<double>")).alias("features"))
    if sample is not None and (n := chosen.count()) > sample:
        chosen = chosen.sample(sample / n, seed=seed)
    return np.array(KMeans(k=lists, seed=seed, maxIter=10, initMode="k-means||").fit(chosen).clusterCenters())


def assign(rows: DataFrame, centroids: np.ndarray, vector_col: str = "vector") -> DataFrame:
    """rows with `cid`, the nearest centroid (the first of equals); every row is indexed."""

    @F.pandas_udf("int")
    def nearest(batch):
        v = np.stack(batch.to_numpy()).astype(np.float64)
        d = (centroids**2).sum(axis=1) - 2 * v @ centroids.T
        return batch.__class__(d.argmin(axis=1).astype(np.int32))

    return rows.where(F.col(vector_col).isNotNull()).withColumn("cid", nearest(F.col(vector_col)))


def write_index(rows: DataFrame, centroids: np.ndarray, path: str, vector_col: str = "vector") -> None:
    """The inverted file as Parquet, a folder for each centroid, so that a probe reads only its lists; with the centroids beside it."""
    spark = rows.sparkSession
    assign(rows, centroids, vector_col).repartition("cid").write.partitionBy("cid").mode("overwrite").parquet(f"{path}/lists")
    spark.createDataFrame([(i, [float(x) for x in c]) for i, c in enumerate(centroids)], "cid int, centroid array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")


def read_index(spark, path: str) -> tuple[DataFrame, np.ndarray]:
    rows = sorted(spark.read.parquet(f"{path}/centroids").collect(), key=lambda r: r.cid)
    return spark.read.parquet(f"{path}/lists"), np.array([r.centroid for r in rows])


def probe(index: DataFrame, centroids: np.ndarray, queries: DataFrame, k: int = 10, probes: int = 4, metric: str = "cosine", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Approximate batch_top_k: each query meets only the rows of its `probes` nearest centroids, list by list (see met). Lists that no query probes are not read."""
    near = F.lit([[float(x) for x in c] for c in centroids])
    d = F.transform(near, lambda c: V.euclidean(F.col("vector").cast("array<double>"), c))
    best = F.slice(F.array_sort(F.transform(d, lambda x, i: F.struct(x.alias("d"), i.alias("cid")))), 1, probes)
    asked = queries.where("vector IS NOT NULL").select("query_id", F.col("vector").cast("array<float>").alias("vector"))
    asked = saved(asked.withColumn("part", F.explode(best["cid"])))
    wanted = [r.part for r in asked.select("part").distinct().collect()]  # lists at most
    rows = index.where(F.col("cid").isin(wanted) & F.col(vector_col).isNotNull()).select(F.col("cid").cast("int").alias("part"), F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("vector"))
    return ranked(_vectors_met(asked, rows, k, metric), k, "query_id").select("query_id", "rank", "id", "score")
