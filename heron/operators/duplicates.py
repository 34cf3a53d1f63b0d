"""Duplicates: equal texts by hash, and groups of vectors joined by chains of high cosine similarity."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.operators import links, search
from heron.operators.graph import components
from heron.operators.staging import saved, small_side, written

#: Rows of a bucket that are meant to meet at most; probability that a pair at the threshold meets in no signature.
BUCKET, MISSED = 512, 1e-3
#: Vectors that are signed at once.
SIGNED = 1024


def exact_groups(docs: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(first_id, n, chars): groups of two or more rows with equal texts, by their SHA-256; null texts have no group."""
    key = F.sha2(F.col(text_col).cast("binary"), 256).alias("key")
    groups = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), key, F.length(text_col).alias("chars")).groupBy("key").agg(F.min("id").alias("first_id"), F.count("*").alias("n"), F.max("chars").alias("chars"))
    return groups.where("n > 1").select("first_id", "n", "chars")


def plan_signatures(n: int, threshold: float) -> tuple[int, int]:
    """Hyperplanes of a signature (log2 of n / BUCKET, 8 at least) and the signatures it takes to miss a pair at the threshold with MISSED."""
    planes = max(8, math.ceil(math.log2(max(1, n) / BUCKET)))
    meets = (1 - math.acos(threshold) / math.pi) ** planes
    return planes, math.ceil(math.log(MISSED) / math.log1p(-meets)) if meets < 1 else 1


def signatures(rows: DataFrame, id_col: str, vector_col: str, planes: int, n: int, seed: int = 7) -> DataFrame:
    """(id, band, signature, v): on which side of random hyperplanes each vector lies, `planes` bits for each band, and the vector as float32 bytes."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = None
        for whole in batches:
            for i in range(0, whole.num_rows, SIGNED):
                b = whole.slice(i, SIGNED)
                v = np.asarray(b.column(1).flatten(), np.float32).reshape(b.num_rows, -1)
                normals = np.random.default_rng(seed).standard_normal((v.shape[1], planes * n)) if normals is None else normals
                bits = ((v.astype(np.float64) @ normals) > 0).reshape(b.num_rows, n, planes) @ (1 << np.arange(planes))
                at = pa.array(np.repeat(np.arange(b.num_rows), n))
                yield pa.RecordBatch.from_arrays([b.column(0).take(at), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows)), pa.array(bits.ravel().astype(np.int64)), pa.array([x.tobytes() for x in v], pa.binary()).take(at)], names=["id", "band", "signature", "v"])

    return rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v")).mapInArrow(run, f"id {kind}, band int, signature long, v binary")


def _units(vectors: list[bytes]) -> np.ndarray:
    v = np.frombuffer(b"".join(vectors), np.float32).reshape(len(vectors), -1).astype(np.float64)
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300)


def _collapsed(rows: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, DataFrame]:
    """The first row (id, v) of each set of equal vectors, and the others as pairs (a, b, score) with it."""
    vector = F.col(vector_col).cast("array<float>")
    known = rows.where(F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), vector.alias("v"))
    keyed = known.withColumn("key", F.sha2(F.array_join(F.col("v").cast("array<string>"), ","), 256))
    firsts = keyed.groupBy("key").agg(F.min("id").alias("first"))  # partial sums, so a third of all rows may be equal
    matched = keyed.join(firsts, "key")
    return matched.where("id = first").select("id", "v"), matched.where("id != first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("score"))


def _signed(single: DataFrame, threshold: float) -> DataFrame:
    """(group, node, v): the rows under each of their signatures."""
    planes, bands = plan_signatures(single.count(), threshold)
    return signatures(single, "id", "v", planes, bands).select(F.xxhash64("band", "signature").alias("group"), F.col("id").alias("node"), "v")


def similar_pairs(rows: DataFrame, threshold: float = 0.9, id_col: str = "id", vector_col: str = "vector", exact: bool = False) -> DataFrame:
    """(a, b, score), a < b, of the pairs with a cosine of at least `threshold`.

    Candidates share a hyperplane signature; they are verified where they meet, by matrix products of blocks of BUCKET
    rows, so that only the pairs found leave a task. Signatures grow with the table, so buckets don't. exact = True
    compares all pairs in blocks instead. Equal vectors are collapsed first, so copies cost no pairs among themselves:
    each copy is paired with its first row.
    """
    single, copies = _collapsed(rows, id_col, vector_col)
    if exact:
        return search.similar_pairs(single, threshold, "id", "v").unionByName(copies)
    signed = written(_signed(saved(single), threshold))
    kind = signed.schema["node"].dataType.simpleString()
    sizes = signed.groupBy("group").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("blocks")).where("blocks > 1")
    # A bucket of more than BUCKET rows is dealt into blocks, and each pair of blocks is a unit of its own.
    dealt = signed.join(small_side(saved(sizes)), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    keyed = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"x": F.least("own", "other"), "y": F.greatest("own", "other")})
    units = keyed.select("group", "x", "y", "own", "node", "v").repartition("group", "x", "y").sortWithinPartitions("group", "x", "y", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (_, x, y), members in links.sorted_groups(batches, 3):
            if len(members) < 2:
                continue
            own, nodes, vectors = (list(c) for c in zip(*members))
            v, home = _units(vectors), np.array(own)
            a, b = np.flatnonzero(home == x), np.flatnonzero(home == y)
            s = v[a] @ v[b].T
            p, q = np.nonzero(s >= threshold)
            if x == y:
                p, q = p[once := a[p] < b[q]], q[once]
            both = zip((nodes[i] for i in a[p]), (nodes[i] for i in b[q]), s[p, q].tolist())
            found = [(min(m, n), max(m, n), c) for m, n, c in both if m != n]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], names=["a", "b", "score"])

    pairs = units.mapInArrow(run, f"a {kind}, b {kind}, score double").groupBy("a", "b").agg(F.max("score").alias("score"))
    return pairs.unionByName(copies)


def similar_groups(rows: DataFrame, threshold: float = 0.9, id_col: str = "id", vector_col: str = "vector", exact: bool = False) -> DataFrame:
    """(id, component): rows that are similar to some other row, and their group, named by its smallest id. Without exact, the members of a signature are joined by as many links as it takes, not by all pairs (see links.group_links)."""
    if exact:
        pairs = similar_pairs(rows, threshold, id_col, vector_col, exact).select(F.col("a").alias("u"), F.col("b").alias("v"))
        return components(saved(pairs)).withColumnRenamed("node", "id")
    single, copies = _collapsed(rows, id_col, vector_col)

    def verify(columns: list[list], in_a: np.ndarray, in_b: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
        v, a, b = _units(columns[0]), np.flatnonzero(in_a), np.flatnonzero(in_b)
        near = v[a] @ v[b].T >= threshold
        p, q = np.nonzero(near & (classes[a][:, None] != classes[b][None, :]))
        if len(p) <= 2 * len(v):
            return list(zip(a[p].tolist(), b[q].tolist()))
        row_of, full = dict(zip(a.tolist(), range(len(a)))), np.zeros((len(a), len(v)), bool)
        full[:, b] = near
        return links.forest(in_a, in_b, classes, lambda i: full[row_of[i]])

    found = links.group_links(written(_signed(saved(single), threshold)), ["v"], verify, BUCKET)
    return components(saved(found.unionByName(copies.select(F.col("a").alias("u"), F.col("b").alias("v"))))).withColumnRenamed("node", "id")


def redundant(groups: DataFrame) -> DataFrame:
    """All but the first id of each group."""
    return groups.where("id != component").select("id")
