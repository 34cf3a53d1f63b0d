"""Queries on capacity, clean-up, canonical forms and memory."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.functions import canonical, chunking
from heron.functions import vectors as V
from heron.operators import capacity, logs, search
from heron.plans.tables import table
from heron.streaming import ingest

KEY = b"not a secret"


def _states(rows: DataFrame):
    return F.when(F.col("event_type") == "error", "failed").when(F.col("event_type") == "purchase", "completed").when(F.col("event_type") == "click", "active").otherwise("pending")


def queue(spark, d):
    rows = table(spark, d, "events")
    return capacity.queue_stats(rows, _states(rows), F.floor("value"))


def cleanup(spark, d):
    """Dry run of the clean-up by usage: the oldest fifth of the events, 100 of which stay at least."""
    gone = logs.expired(table(spark, d, "events").select("ts", "event_id", "props"), "ts", "event_id", usage_percent=80, keep_least=100)
    return capacity.cleanup_estimate(gone, F.octet_length("props"))


def batch_sizes(spark, d):
    rows = table(spark, d, "events").where("user_id IS NOT NULL")
    cores, memory = F.col("user_id") % 16 + 1, F.col("event_id") % 32 + 1
    return rows.select("event_id", capacity.batch_size(F.lit(32), cores, memory, F.col("event_type") == "click", 4, 256, 1.5).alias("batch"))


def priority(spark, d):
    rows = table(spark, d, "events").withColumn("priority", F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2))
    return capacity.by_priority(rows.select("event_id", "priority"), "priority", "event_id").select("event_id", "place")


def keys(spark, d):
    return capacity.metadata_keys(table(spark, d, "events"), F.col("props"), special=("id", "vector"))


def sentiment(spark, d):
    label = F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral")
    return capacity.sentiment_stats(table(spark, d, "labels"), label, F.col("quality") - F.col("toxic")).withColumn("avg_score", F.round("avg_score", 6))


def canonical_props(spark, d):
    mixed = F.concat(F.lit('{ "z": 1, "k": '), F.get_json_object("props", "$.k"), F.lit(', "a": [1, {"d": 2, "c": "x"}] }'))
    return table(spark, d, "events").select("event_id", canonical.canonical_json(mixed).alias("json"))


def keyed_digest(spark, d):
    return table(spark, d, "documents").select("doc_id", F.lower(F.hex(canonical.hmac_sha256(KEY, F.coalesce("text", F.lit(""))))).alias("digest"))


def loudness(spark, d):
    rms = V.norm(F.col("embedding")) / F.sqrt(F.size("embedding"))
    return table(spark, d, "embeddings").select("vec_id", F.round(canonical.decibels(rms), 5).alias("db"))


def memory(spark, d):
    """The five best memories of one role: the ten most similar of at least 0.1, then those of the role."""
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    first = rows.where("id = 0").select("vector").first()  # the query vector: one row
    best = search.top_k(rows, list(first.vector) if first else [], 10, threshold=0.1)
    kept = best.join(rows.select("id", "label"), "id").where(F.col("label") % 2 == 0)
    return kept.orderBy(F.desc("score"), "id").limit(5).select("id", F.round("score", 6).alias("score"))


def exported(spark, d):
    """Documents with their vectors where they have one."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"), F.size("embedding").cast("long").alias("dimensions"))
    return table(spark, d, "documents").select("doc_id", "source").join(vectors, "doc_id", "left")


def drifted(spark, d):
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.when(F.col("label") < 5, "new").when(F.col("label") < 9, "old").alias("model"))
    return ingest.stale(rows, "new", after=100).select("id")


def semantic(spark, d):
    """Turns of each conversation as segments, with vectors made of hashes of their texts."""
    turns = table(spark, d, "conversations").select("conv_id", "turn", "text")
    made = turns.withColumn("vector", F.array(*[F.pmod(F.xxhash64("text", F.lit(i)), F.lit(1000)).cast("float") for i in range(8)]))
    return chunking.semantic_chunks(made, "conv_id", "turn", "text", "vector", most=1500, least=200)


QUERIES = {
    "queue_stats": queue, "cleanup_estimate": cleanup, "batch_size": batch_sizes, "priority_order": priority, "metadata_keys": keys, "sentiment_stats": sentiment, "canonical_json": canonical_props,
    "hmac_digest": keyed_digest, "loudness_db": loudness, "memory_retrieve": memory, "export_join": exported, "reindex_stale": drifted, "semantic_sized": semantic,
}

_PADS = [bytes(b ^ x for b in KEY.ljust(64, b"\0")).hex() for x in (0x36, 0x5C)]

SQL = {
    "queue_stats": """SELECT count(*) FILTER (event_type IN ('view', 'signup')) AS pending, count(*) FILTER (event_type = 'click') AS active, count(*) FILTER (event_type = 'purchase') AS completed, count(*) FILTER (event_type = 'error') AS failed,
        CAST(floor(sum(floor(value)) FILTER (event_type IN ('purchase', 'error')) / count(*) FILTER (event_type = 'purchase') + 0.5) AS BIGINT) AS avg_latency_ms FROM events""",
    "cleanup_estimate": "SELECT count(*) AS n, CAST(coalesce(sum(strlen(props)), 0) AS BIGINT) AS bytes FROM (SELECT props, row_number() OVER (ORDER BY ts, event_id) AS k, count(*) OVER () AS n FROM events) WHERE k <= floor(n * 20 / 100) AND k <= n - 100",
    "batch_size": "SELECT event_id, CAST(greatest(4, least(256, floor(32 * ((user_id % 16 + 1) / 4) * ((event_id % 32 + 1) / 8) * CASE WHEN event_type = 'click' THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END))) AS BIGINT) AS batch FROM events WHERE user_id IS NOT NULL",
    "priority_order": "SELECT event_id, row_number() OVER (ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) - 1 AS place FROM events",
    "metadata_keys": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) WHERE key NOT IN ('id', 'vector') GROUP BY key",
    "sentiment_stats": "SELECT count(*) AS n, count(*) FILTER (toxic = 0 AND quality = 1) AS positive, count(*) FILTER (toxic = 1) AS negative, count(*) FILTER (toxic = 0 AND quality = 0) AS neutral, round(avg(quality - toxic), 6) AS avg_score FROM labels",
    "canonical_json": """SELECT event_id, '{"a":[1,{"c":"x","d":2}],"k":' || (props->>'$.k') || ',"z":1}' AS json FROM events""",
    "hmac_digest": f"SELECT doc_id, sha256(unhex('{_PADS[1]}') || unhex(sha256(unhex('{_PADS[0]}') || encode(coalesce(text, ''))))) AS digest FROM documents",
    "loudness_db": "SELECT vec_id, round(greatest(-200, 20 * log10(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) / len(embedding)))), 5) AS db FROM embeddings",
    "memory_retrieve": """WITH e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings), t AS (SELECT e.id, e.label, list_cosine_similarity(e.v, q.v) AS s FROM e, (SELECT v FROM e WHERE id = 0) q ORDER BY s DESC, e.id LIMIT 10)
        SELECT id, round(s, 6) AS score FROM t WHERE s >= 0.1 AND label % 2 = 0 ORDER BY s DESC, id LIMIT 5""",
    "export_join": "SELECT doc_id, source, CAST(len(embedding) AS BIGINT) AS dimensions FROM documents LEFT JOIN embeddings ON doc_id = vec_id",
    "reindex_stale": "SELECT vec_id AS id FROM embeddings WHERE label >= 5 AND vec_id > 100",
}
