"""Packing along a space-filling curve: documents are ordered by the Hilbert key of a projection of their hashed vectors and fill sequences one after the other."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import constants, mix, running_totals, small_batches, table, with_fields, written
from heron.llm.tokens import encoder, public_path

SEQUENCE = 2048
END_ID = 1
DIMENSIONS, BITS = 3, 16


def directions(vocabulary: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """A row of +-1 (by hash) for each feature: the projection of a hashed count vector to few dimensions."""
    h = mix(np.arange(1, vocabulary + 1, dtype=np.uint64) * constants(1, 23)[0])
    return np.stack([((h >> np.uint64(d)) & np.uint64(1)).astype(np.float32) * 2 - 1 for d in range(dimensions)], axis=1)


def grid(sums: np.ndarray, norms: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Cells of the projections of L2-normalised vectors: [-4, 4], where nearly all lie, is cut evenly, so no statistics are needed."""
    unit = sums / np.maximum(norms, 1e-9)[:, None] / 4
    return np.clip((unit + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.uint64)


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert keys of rows of integer coordinates, after Skilling (2004): undo the rotations from the top bit, then interleave the Gray code."""
    x = cells.T.copy()
    n = len(x)
    top = np.uint64(1) << np.uint64(bits - 1)
    bit = top
    while bit > 1:
        low = bit - np.uint64(1)
        for i in range(n):
            set_ = (x[i] & bit) != 0
            swap = np.where(set_, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(set_, low, swap)
            x[i] ^= swap
        bit >>= np.uint64(1)
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, bit = np.zeros_like(x[0]), top
    while bit > 1:
        flip ^= np.where((x[n - 1] & bit) != 0, bit - np.uint64(1), np.uint64(0))
        bit >>= np.uint64(1)
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << np.uint64(1) | (x[i] >> np.uint64(b)) & np.uint64(1)
    return key.astype(np.int64)


def encoded(docs: DataFrame, id_col: str, text_col: str, path: str, end_id: int) -> DataFrame:
    """id, tokens (with the end id), curve (Hilbert key), ids (bytes)."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        table_of, end = directions(coder.size), np.array([end_id], coder.dtype).tobytes()
        for batch in batches:
            ids = coder.encode(batch.column(1).to_pylist())
            sums, norms = np.zeros((len(ids), DIMENSIONS)), np.zeros(len(ids))
            for i, b in enumerate(ids):
                if b:
                    seen, counts = np.unique(np.frombuffer(b, coder.dtype), return_counts=True)
                    weights = np.sqrt(counts)
                    sums[i], norms[i] = weights @ table_of[seen], np.sqrt(counts.sum())
            width = np.dtype(coder.dtype).itemsize
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(b) // width + 1 for b in ids], pa.int64()), pa.array(hilbert(grid(sums, norms))), pa.array([b + end for b in ids], pa.binary())], names=["id", "tokens", "curve", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, with_fields(docs.select(F.col(id_col).alias("id")), "tokens long, curve long, ids binary"))


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = END_ID, length: int = SEQUENCE) -> DataFrame:
    """Sequences of `length` tokens as pieces: (id, start, length, ids_crc32, doc_tokens, sequence_id, offset, curve, ids).

    Documents, each with `end_id` behind it, are laid end to end in the order of the curve and cut every `length` ids,
    so that neighbours in a sequence are alike and only the last sequence is padded. The order along the curve is a
    global sort of slim rows; token ids are encoded once, kept in a table and joined to their places by row.

    A null text is empty: one piece with the end id. Rows that repeat an id or a text are packed each; ties on the curve
    take any order. A very long text is encoded whole, in one task. An empty table gives no rows. Other columns,
    whatever their names, are ignored.
    """
    path = path or public_path()
    tokens = written(encoded(docs, id_col, text_col, path, end_id).withColumn("at", F.monotonically_increasing_id()))
    placed = running_totals(tokens.select("curve", "at", "tokens"), ["curve", "at"], "tokens").select("at", "before")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = encoder(path).dtype
        for batch in batches:
            cols: list[list] = [[] for _ in range(9)]
            for key, curve, before, raw in zip(*(c.to_pylist() for c in batch.columns)):
                ids = np.frombuffer(raw, dtype).astype("<u4")
                start, n = 0, len(ids)
                while start < n:
                    sequence, offset = divmod(before + start, length)
                    stop = min(n, start + length - offset)
                    piece = ids[start:stop].tobytes()
                    for c, v in zip(cols, (key, start, stop - start, zlib.crc32(piece), n, sequence, offset, curve, piece)):
                        c.append(v)
                    start = stop
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in cols[1:8]), pa.array(cols[8], pa.binary())], names=names)

    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve", "ids"]
    schema = with_fields(tokens.select("id"), ", ".join(f"{name} long" for name in names[1:8]) + ", ids binary")
    return tokens.select("at", "id", "curve", "ids").join(placed, "at").select("id", "curve", "before", "ids").mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 7."""
    pieces = packed(table(spark, sf_dir, "documents"))
    return pieces.select(F.col("id").alias("doc_id"), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "curve")
