"""Document fingerprints by order MinHash: minimal occurrence-numbered k-mers, kept in text order, hashed as tuples."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import constants, mix, shuffle_partitions, small_batches, table, with_fields
from heron.operators.logs import slot_of

#: Code points of a k-mer, k-mers of a tuple, tuples of a fingerprint.
K, TUPLE, SIZE = 8, 2, 64
#: Bits of the hash by which rows without id, and those of a frequent id, are cut; rows of an id that make it frequent at least.
HOT_BITS, FREQUENT = 6, 1000
#: Elements that are ranked at once; no image of an element is above this.
SPAN, MOST = 1024, np.uint32(0xFFFFFFFF)


def kmers(text: str, k: int = K) -> np.ndarray:
    """64-bit hashes of the k-mers of code points; of a shorter text, one of the whole."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    if len(points) < k:
        return mix(np.atleast_1d((points * constants(len(points), 29)).sum() + np.uint64(len(points))))
    steps, span, h = constants(k.bit_length(), 31), 1, points
    while 2 * span <= k:  # spans of 2, 4, 8, ... code points
        h = h[:-span] * steps[span.bit_length() - 1] + h[span:]
        span *= 2
    if span < k:
        h = h[: len(points) - k + 1] * steps[-1] + h[k - span :]
    return mix(h.copy() if h is points else h)


@lru_cache(maxsize=1)
def scratch(n: int) -> np.ndarray:
    """A buffer of this process that is written anew by each use."""
    return np.empty(n, np.uint32)


def least_places(h: np.ndarray, orders: np.ndarray, take: int) -> np.ndarray:
    """For each order, a multiplication of the 32-bit hashes by an odd number, the places of its `take` least elements: (orders, take).

    Elements are looked at in blocks; each block's least ones stay candidates. Of equal images the first counts.
    """
    lines, buffer, at, least = np.arange(len(orders)), scratch(len(orders) * SPAN), [], []
    for i in range(0, len(h), SPAN):
        part = h[i : i + SPAN]
        images = np.multiply(orders[:, None], part[None, :], out=buffer[: len(orders) * len(part)].reshape(len(orders), -1))
        for _ in range(min(take, len(part))):
            place = images.argmin(axis=1)
            at.append(place + i), least.append(images[lines, place])
            images[lines, place] = MOST
        if len(at) >= 64 * take:
            at, least = _best(at, least, take)
    return np.stack(at if len(at) == take else _best(at, least, take)[0], axis=1)


def _best(at: list[np.ndarray], least: list[np.ndarray], take: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    found = np.stack(least)
    best = np.argsort(found, axis=0, kind="stable")[:take]
    return list(np.take_along_axis(np.stack(at), best, 0)), list(np.take_along_axis(found, best, 0))


def numbered(h: np.ndarray) -> np.ndarray:
    """Hashes of the occurrence-numbered k-mers: the n-th occurrence of a k-mer, n > 0, is an element of its own."""
    order = np.argsort(h, kind="stable")
    ranked = h[order]
    same = np.flatnonzero(ranked[1:] == ranked[:-1]) + 1
    if not len(same):
        return h
    new = np.ones(len(h), bool)
    new[same] = False
    first = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    number = (same - first[same]).astype(np.uint64)
    out = h.copy()
    out[order[same]] = mix(ranked[same] + number * np.uint64(0xA0761D6478BD642F))
    return out


def order_minhash(text: str, k: int = K, tuple_size: int = TUPLE, size: int = SIZE) -> np.ndarray:
    """The fingerprint's tuple hashes (16 bits each).

    Each of `size` independent orders of the occurrence-numbered k-mers ranks them by a hash of its own; its
    `tuple_size` least elements, in text order, make the tuple. Hence two fingerprints agree in a place if the same
    k-mers are minimal and follow each other in the same order, as they do in texts that few edits part.
    """
    if not text:
        return np.zeros(size, np.uint16)
    h = kmers(text, k)
    take = min(tuple_size, len(h))
    orders, elements = (constants(size, 43) >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (numbered(h) >> np.uint64(32)).astype(np.uint32)
    places = np.sort(least_places(elements, orders, take), axis=1)
    tuples = (h[places] * constants(take, 37)).sum(axis=1) + constants(size, 41)
    return (mix(tuples) >> np.uint64(48)).astype(np.uint16)


def text_of(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u2").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the places in which two fingerprints agree, 0 to 1."""
    return float((a == b).mean())


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K, tuple_size: int = TUPLE, size: int = SIZE) -> DataFrame:
    """(id, fingerprint): a hex string of `size` tuple hashes for each row.

    Null and empty texts have the fingerprint of the empty text; equal texts have equal ones. A very long text takes
    about 50 bytes of memory for each of its characters. An empty table gives no rows; rows are not compared with each
    other, so repeated ids, ids of other types and other columns don't matter.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [text_of(order_minhash(t or "", k, tuple_size, size)) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.string())], names=["id", "fingerprint"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, with_fields(docs.select(F.col(id_col).alias("id")), "fingerprint string"))


def followed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (bucket, tail, id, text) in partitions where each row, but those with tail = true, stands right before the next by descending id.

    Ids (integers) are cut into ranges at approximate quantiles, which a scan of the ids alone gives. Rows of one id stand
    in the order of a hash of their text; rows without id, and those of an id that would fill a range by itself, are
    cut by that hash further. The row after a range's last one is the row with the
    greatest id below the range (for the lowest range, of all): it is added to the range as its tail. So texts are
    shuffled once, and only a row for each range twice.
    """
    text = F.col(text_col).cast("string")
    key, order = F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64(text).alias("order")
    keys, ranges = docs.select(F.col(id_col).cast("long").alias("key")), 4 * shuffle_partitions(docs.sparkSession)
    known = keys.agg(F.percentile_approx("key", [i / ranges for i in range(1, ranges)], 20 * ranges).alias("q"), F.count("key").alias("n")).first()
    often = [x.key for x in keys.where("key IS NOT NULL").groupBy("key").count().where(F.col("count") > max(FREQUENT, known.n // ranges)).collect()]  # fewer than ranges
    lone = [-(1 << 63), *often]  # null, and ids that are ranges of their own
    cuts = sorted({*(known.q or []), *(x + d for x in lone for d in (0, 1) if -(1 << 63) < x + d < 1 << 63)})
    part = F.when(F.col("key").isin(lone), F.shiftright("order", 64 - HOT_BITS).cast("int") + (1 << HOT_BITS - 1)).otherwise(F.lit(0))
    bucket = slot_of(F.col("key"), cuts) * (1 << HOT_BITS) + part
    placed = docs.select(key, order).select("key", "order", bucket.alias("bucket"))
    tops = sorted((x.bucket, x.top.key, x.top.order) for x in placed.groupBy("bucket").agg(F.max(F.struct("key", "order")).alias("top")).collect())  # a row for each range
    rows = docs.select(key, order, F.col(id_col).cast("long").alias("id"), text.alias("text"))
    own = rows.select(bucket.alias("bucket"), F.lit(False).alias("tail"), "key", "order", "id", "text")
    if tops:
        tails = [(b, *tops[i - 1][1:]) for i, (b, *_) in enumerate(tops)]  # the lowest range gets the greatest of all
        wanted = docs.sparkSession.createDataFrame(tails, "bucket int, key long, order long")
        extra = rows.where(F.col("key").isin(sorted({k for _, k, _ in tails}))).join(F.broadcast(wanted), ["key", "order"]).select("bucket", F.lit(True).alias("tail"), "key", "order", "id", "text")
        own = own.unionByName(extra)
    return own.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc("key"), F.desc("order")).select("bucket", "tail", "id", "text")


def edited(text: str, following: str) -> str:
    """text with its last half (rounded down) replaced by as many of the first code points of the following text, or all of them."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each text and of its edited text, with their likeness to each other and to the next document's.

    The next document is that with the next lower id (ties by a hash of the text; null ids stand below all others); after the last
    comes the first. A lone document is its own next one. A null text is empty. Two very long texts, which follow each
    other, and their edit are in memory at once, about 50 bytes for each of their characters. An empty table gives no
    rows. Other columns, whatever their names, are ignored.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cols: list[list] = [[] for _ in range(7)]

        def put(row, following) -> None:
            _, tail, key, text, own = row
            if tail:
                return
            change = edited(text, following[3])
            other = order_minhash(change)
            for c, v in zip(cols, (key, len(text), hashlib.sha256(change.encode()).hexdigest(), text_of(own), text_of(other), likeness(own, other), likeness(own, following[4]))):
                c.append(v)

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names)
            for c in cols:
                c.clear()
            return made

        last = None
        for batch in batches:
            for bucket, tail, key, text in zip(*(c.to_pylist() for c in batch.columns)):
                if last is not None and last[0] == bucket and last[1] and tail:
                    continue  # a repeated id among the tails
                row = (bucket, tail, key, text or "", order_minhash(text or ""))
                if last is not None:
                    put(last, row if row[0] == last[0] else last)
                last = row
            if len(cols[0]) > 1000:
                yield out()
        if last is not None:
            put(last, last)
        yield out()

    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    return followed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 4."""
    return compared(table(spark, sf_dir, "documents"))
