"""Helpers shared by the training-data operators: shared scratch space, components, prefix sums and hashes."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.operators.graph import components  # noqa: F401
from heron.operators.links import forest, group_links, sorted_groups, unit_links  # noqa: F401
from heron.operators.staging import remove, saved, shared_dir, shuffle_partitions, small_side, written  # noqa: F401  the operators import them from here

#: Rows in an Arrow batch, so that a batch of long documents stays small.
BATCH_ROWS = 400

MASK = (1 << 64) - 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_fields(df: DataFrame, ddl: str) -> T.StructType:
    """df's schema and further fields."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(ddl).fields])


def small_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of text small: BATCH_ROWS rows beside the session's bound in bytes (arrow.maxBytesPerBatch); a smaller setting stays. No result depends on it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def running_totals(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """df in the global order of `order` with `row` (gapless from 0) and `before` (sum of `value` over all earlier rows).

    The rows are range-partitioned and sorted once, each partition sums by itself, and the totals of the partitions
    (one row each) are summed and added. Keep the rows slim; they are written once so that ranges stay the same.
    Ties in `order` take any order. Rows with a null value count as 0.
    """
    at = [c for c in df.columns].index(value)
    ranged = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id())
    schema = with_fields(ranged, "row long, before long")

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = total = 0
        for b in batches:
            sums = np.cumsum(b.column(at).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            before = np.concatenate([[0], sums[:-1]]) + total if len(sums) else sums
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.arange(rows, rows + b.num_rows)), pa.array(before.astype(np.int64))], names=[*b.schema.names, "row", "before"])
            rows, total = rows + b.num_rows, total + (int(sums[-1]) if len(sums) else 0)

    local = saved(ranged.mapInArrow(summed, schema))
    totals = local.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col(value).cast("long"), F.lit(0))).alias("s"))
    left, n, s = [], 0, 0
    for x in sorted(totals.collect()):  # a row for each partition
        left.append((x.part, n, s))
        n, s = n + x.n, s + x.s
    starts = df.sparkSession.createDataFrame(left, "part int, rows_before long, sum_before long")
    return (
        local.join(F.broadcast(starts), "part")
        .withColumns({"row": F.col("row") + F.col("rows_before"), "before": F.col("before") + F.col("sum_before")})
        .drop("part", "rows_before", "sum_before")
    )


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@lru_cache(maxsize=64)
def constants(n: int, seed: int) -> np.ndarray:
    """n odd pseudo-random 64-bit numbers, not to be written to."""
    out = mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64((seed * 2654435761 + 0x9E3779B97F4A7C15) & MASK)) | np.uint64(1)
    out.setflags(write=False)
    return out


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offsets of its rows; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), offsets


def text_runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with up to `most` bytes (or one row): first row, end row, bytes, offsets from 0."""
    data, offsets = text_bytes(column)
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        yield i, j, data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        i = j


_POWERS = np.ones(1, np.uint64)


def powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        _POWERS = np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(max(n, 4096), 0x9E3779B97F4A7C15 | 1, np.uint64)]))
    return _POWERS


def _is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def word_hashes(data: np.ndarray, offsets: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of rows of UTF-8 text, A-Z lowered, and each row's first word (n + 1 numbers).

    A single row of more than `most` bytes is hashed in parts that end at white space, so that only its hashes grow with it.
    """
    if len(offsets) == 2 and len(data) > most:
        parts, at = [], 0
        while at < len(data):
            end = at + most
            while end < len(data) and not _is_space(data[end : end + 65_536]).any():
                end += 65_536
            end = min(len(data), end + (int(np.argmax(_is_space(data[end : end + 65_536]))) if end < len(data) else 0))
            parts.append(word_hashes(data[at:end], np.array([0, end - at]), end - at)[0])
            at = end
        return np.concatenate(parts), np.array([0, sum(map(len, parts))])
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = data + (((data >= 65) & (data <= 90)).astype(np.uint8) << 5)
    word = ~_is_space(low)
    edge = np.empty(len(word), bool)
    edge[0], edge[1:] = True, ~word[:-1]
    edge[offsets[:-1][offsets[:-1] < len(data)]] = True
    starts = np.flatnonzero(word & edge)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    ends = np.flatnonzero(word & np.append(edge[1:] | ~word[1:], True)) + 1
    lengths = ends - starts
    at = np.flatnonzero(word)
    first = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=first[1:])
    inside = np.arange(len(at)) - np.repeat(first[:-1], lengths)
    sums = np.add.reduceat((low[at].astype(np.uint64) + np.uint64(1)) * powers(int(lengths.max()) + 1)[inside], first[:-1])
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, offsets)


def shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """Of each row the sorted distinct 64-bit hashes of its k-word shingles; with fewer words the whole sequence is one; without words none."""
    weights = constants(k, 3)
    for i, j, data, offsets in text_runs(column):
        words, first = word_hashes(data, offsets)
        n = max(0, len(words) - k + 1)
        grams = np.zeros(n, np.uint64)
        for w in range(k):
            grams += words[w : w + n] * weights[w]
        mix(grams)
        for r in range(j - i):
            a, b = int(first[r]), int(first[r + 1])
            if b - a >= k:
                yield np.unique(grams[a : b - k + 1])
            elif b > a:
                yield mix(np.atleast_1d((words[a:b] * constants(b - a, 5)).sum() + np.uint64(b - a)))
            else:
                yield np.zeros(0, np.uint64)
