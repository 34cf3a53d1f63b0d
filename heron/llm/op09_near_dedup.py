"""MinHash near-dedup: banded candidates, verified by odd sketches and then on whole shingle sets."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import components, constants, forest, group_links, mix, saved, shingles, small_batches, small_side, table, with_fields, written

ROWS, BANDS = 5, 30
SKETCH_BITS = 512
#: Rows of a block of a band, and of a group of candidates.
SKETCH_BLOCK, SET_BLOCK = 1024, 256
#: Rows with sketches that are broadcast at most.
SKETCHES = 300_000


def signature(values: np.ndarray, multipliers: np.ndarray) -> np.ndarray:
    """MinHash samples of a set of 64-bit hashes: the least image under each multiplication."""
    least = np.full(len(multipliers), 0xFFFFFFFFFFFFFFFF, np.uint64)
    for i in range(0, len(values), 2048):
        np.minimum(least, np.multiply(multipliers[:, None], values[None, i : i + 2048]).min(axis=1), out=least)
    return least


def odd_sketch(samples: np.ndarray, salts: np.ndarray, bits: int = SKETCH_BITS) -> bytes:
    """The parity, for each bit, of the samples that hash to it."""
    at = mix(samples + salts) >> np.uint64(64 - int(math.log2(bits)))
    return np.packbits((np.bincount(at.astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def sketch_similarity(differing_bits: float, samples: int = ROWS * BANDS, bits: int = SKETCH_BITS) -> float:
    """Estimated Jaccard similarity from the population count of the XOR of two odd sketches."""
    left = 1 - 2 * differing_bits / bits
    return 1 + bits / (4 * samples) * math.log(left) if left > 0 else 0.0


def most_bits(threshold: float, slack: float = 0.3) -> int:
    """Differing bits up to which a pair may have `threshold`; the slack is six standard errors and more, so that none is lost."""
    return max(d for d in range(SKETCH_BITS // 2) if sketch_similarity(d) >= threshold - slack)


def features(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """id, text_key, n_shingles, set_key (equal sets, equal keys; null for an empty set), bands, sketch."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        multipliers, salts, turns = constants(ROWS * BANDS, 11), constants(ROWS * BANDS, 13), constants(ROWS, 17)
        bands_of = np.arange(BANDS, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for batch in batches:
            n, keys, bands, sketches = [], [], [], []
            for values in shingles(batch.column(2), k):
                n.append(len(values))
                if not len(values):
                    keys.append(None), bands.append(None), sketches.append(None)
                    continue
                samples = signature(values, multipliers)
                keys.append(xxhash.xxh3_128_digest(values.tobytes()))
                bands.append(mix((samples.reshape(BANDS, ROWS) * turns).sum(axis=1) + bands_of).view(np.int64))
                sketches.append(odd_sketch(samples, salts))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], names=["id", "text_key", "n_shingles", "set_key", "bands", "sketch"])

    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return slim.mapInArrow(run, with_fields(slim.drop("text"), "n_shingles long, set_key binary, bands array<long>, sketch binary"))


def differing_bits(sketches: list[bytes]) -> Callable[[int], np.ndarray]:
    """Of a row's sketch and all the others the population count of their XOR."""
    bits = np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), -1)
    return lambda a: np.bitwise_count(bits ^ bits[a]).sum(axis=1)


def sketch_links(buckets: DataFrame, most: int) -> DataFrame:
    """(u, v) that join the members (group, node, sketch) of each band whose odd sketches differ in at most `most` bits."""

    def verify(columns: list[list], in_a: np.ndarray, in_b: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
        sketches = columns[0]
        if len(sketches) == 2:
            near = sketches[0] == sketches[1] or (int.from_bytes(sketches[0]) ^ int.from_bytes(sketches[1])).bit_count() <= most
            return [(0, 1)] if near else []
        bits = differing_bits(sketches)
        return forest(in_a, in_b, classes, lambda a: bits(a) <= most)

    return group_links(buckets, ["sketch"], verify, SKETCH_BLOCK)


def set_links(members: DataFrame, percent: int, most: int) -> DataFrame:
    """(u, v) that join the members (group, node, sketch, shingles) as the exact graph does: 100 * intersection >= percent * union of the whole sets.

    Pairs whose sketches differ in more than `most` bits, or whose sizes alone forbid a link, are not intersected.
    """

    def verify(columns: list[list], in_a: np.ndarray, in_b: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
        bits, sets = differing_bits(columns[0]), [np.frombuffer(x, np.uint64) for x in columns[1]]
        sizes = np.array([len(x) for x in sets])

        def near(a: int) -> np.ndarray:
            return (bits(a) <= most) & (100 * np.minimum(sizes, sizes[a]) >= percent * np.maximum(sizes, sizes[a]))

        def linked(a: int, b: int) -> bool:
            both = int(np.isin(sets[a], sets[b], assume_unique=True).sum()) if sizes[a] < 64 else len(np.intersect1d(sets[a], sets[b], assume_unique=True))
            return 100 * both >= percent * (sizes[a] + sizes[b] - both)

        return forest(in_a, in_b, classes, near, linked)

    return group_links(members, ["sketch", "shingles"], verify, SET_BLOCK, weight=F.octet_length("shingles"))


def _sets(docs: DataFrame, id_col: str, text_col: str, k: int, nodes: DataFrame) -> DataFrame:
    """node, group, sketch, shingles (sorted 64-bit hashes as bytes) of the documents in nodes (node, text_key, group, sketch), repeated rows once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([x.tobytes() for x in shingles(batch.column(3), k)], pa.binary())], names=["node", "group", "sketch", "shingles"])

    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).alias("node"), F.xxhash64(text).alias("text_key"), text.alias("text")).join(small_side(nodes, SKETCHES), ["node", "text_key"])
    slim = texts.dropDuplicates(["node", "text_key"]).select("node", "group", "sketch", "text")
    return slim.mapInArrow(run, with_fields(slim.drop("text"), "shingles binary"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """Groups of near-duplicate documents: (id, n_shingles, component_id, kept), a row for each row of docs.

    Two documents are linked if the Jaccard similarity of their sets of k-word shingles is percent/100 or more; a
    group is a connected component of links and is named by its smallest id, whose row has kept = true. Ids are of any
    type with an order. Rows with equal sets are collapsed before the search, so copies cost no pairs. A pair at the
    very threshold of 0.8 is missed by the bands with a probability under 1e-5 (0.85: 2e-8); every link found is
    confirmed on the whole sets. Bands and groups of candidates of any size are dealt into blocks (see group_links).

    Null or blank texts have an empty set and are linked with nothing. A row without id stays alone, with a null
    component and kept = true. Rows that repeat an id count as one node, with the links of all of them. A very long
    text takes about 16 bytes of memory for each of its words, and a single word without white space about 43 bytes for
    each of its bytes. An empty table gives no rows. Other columns of docs,
    whatever their names, are ignored.
    """
    feats = written(features(docs, id_col, text_col, k).withColumn("row", F.monotonically_increasing_id()))
    known = feats.where("id IS NOT NULL AND set_key IS NOT NULL")
    firsts = known.groupBy("set_key").agg(F.min(F.struct("id", "row")).alias("first"))
    copies = known.select("id", "row", "set_key").join(firsts, "set_key").where("row != first.row").select(F.col("first.id").alias("u"), F.col("id").alias("v"))

    alone = known.join(firsts.select(F.col("set_key").alias("key"), F.col("first.row").alias("at")), (F.col("set_key") == F.col("key")) & (F.col("row") == F.col("at")), "left_semi")
    alone = written(alone.select("id", "text_key", "bands", "sketch"))
    live = alone.select("id", F.explode("bands").alias("group")).groupBy("group").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("group")
    buckets = written(alone.select(F.col("id").alias("node"), "sketch", F.explode("bands").alias("group")).join(small_side(saved(live)), "group"))
    most = most_bits(percent / 100)
    loose = components(sketch_links(buckets, most))

    nodes = loose.join(alone, loose["node"] == alone["id"]).select("node", "text_key", F.col("component").alias("group"), "sketch")
    sets = written(_sets(docs, id_col, text_col, k, saved(nodes)))
    groups = components(set_links(sets, percent, most).unionByName(copies))
    return (
        feats.select("id", "n_shingles").join(groups, F.col("id") == F.col("node"), "left")
        .select("id", "n_shingles", F.coalesce("component", "id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)))
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates: that with the smallest id. Rows of that id all stay, as do rows without id; all columns are those of docs."""
    gone = near_duplicates(docs, id_col, text_col, k, percent).where(~F.col("kept")).select("id").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"))
    return rows.join(small_side(saved(gone)), "id", "left_anti").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 9: 3-word shingles, similarity 0.85."""
    found = near_duplicates(table(spark, sf_dir, "documents"), k=3, percent=85)
    return found.withColumnRenamed("id", "doc_id")


#: All pairs that share a shingle, on whole sets; equal sets are one.
SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS g FROM t),
n AS (SELECT doc_id, len(g) AS n_shingles, list_sort(g)::VARCHAR AS whole FROM s),
f AS (SELECT whole, min(doc_id) AS first FROM n WHERE n_shingles > 0 GROUP BY whole),
u AS (SELECT s.doc_id, n_shingles AS n, unnest(g) AS g FROM s JOIN n ON n.doc_id = s.doc_id JOIN f ON f.whole = n.whole AND f.first = s.doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l AS MATERIALIZED (SELECT a AS u, b AS v FROM p UNION SELECT b, a FROM p UNION SELECT first, doc_id FROM n JOIN f USING (whole) WHERE first != doc_id UNION SELECT doc_id, first FROM n JOIN f USING (whole) WHERE first != doc_id),
r(id, c) AS (SELECT u, u FROM l UNION SELECT l.v, r.c FROM r JOIN l ON l.u = r.id WHERE r.c < l.v),
c AS (SELECT id, min(c) AS c FROM r GROUP BY id)
SELECT doc_id, n_shingles, coalesce(c, doc_id) AS component_id, coalesce(c, doc_id) = doc_id AS kept FROM n LEFT JOIN c ON id = doc_id
"""
