"""Contiguous shards of nearly equal bytes by global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import running_totals, table

SHARDS = 16


def sharded(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """(id, size, text_crc32, shard, slot): documents in the order of their ids, cut where the running size passes equal targets.

    A document's size is the UTF-8 bytes of its text (null: none) plus 1. The shard is that in which the middle of the
    document's bytes falls, so shards are contiguous in id and differ from the target by about a document at most; slot
    counts from 0 within the shard. Slim rows are range-partitioned and summed by partition; the totals of partitions,
    a row each, give the global sums.

    Null ids come first; rows that repeat an id stand together in the order of checksum and size. A shard that no
    document's middle falls into stays empty. An empty table gives no rows. Other columns are ignored.
    A very long text is only measured: no row but its own ever holds it.
    """
    text = F.col(text_col).cast("string")
    slim = docs.select(F.col(id_col).alias("id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"))
    placed = running_totals(slim, ["id", "text_crc32", "size"], "size")
    total = placed.agg(F.coalesce(F.sum("size"), F.lit(1))).first()[0]
    middle = (F.col("before") * 2 + F.col("size")).cast("decimal(20,0)") * shards
    cut = placed.withColumn("shard", F.least(F.floor(middle / F.lit(2 * total).cast("decimal(20,0)")).cast("int"), F.lit(shards - 1)))
    firsts = cut.groupBy("shard").agg(F.min("row").alias("first"))  # a row for each shard
    return cut.join(F.broadcast(firsts), "shard").select("id", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 3, law `bytes`."""
    found = sharded(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: The checksum of the bytes of a text, as its table is defined: eight steps for each byte value.
SQL = f"""
WITH RECURSIVE bits(i, k, x) AS (SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END FROM bits WHERE k < 8),
tab AS MATERIALIZED (SELECT list(x ORDER BY i) AS t FROM bits WHERE k = 8),
b AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, coalesce(text, '') AS text FROM documents),
c AS (SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda h: ('0x' || h)::BIGINT)), lambda a, x: xor(a // 256, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM b, tab),
p AS (SELECT *, sum(size) OVER (ORDER BY doc_id, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM c),
s AS (SELECT *, least({SHARDS - 1}, (2 * before + size) * {SHARDS} // (2 * total)) AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id, text_crc32, size) - 1 AS slot, NULL::INTEGER AS grown_shard FROM s
"""
