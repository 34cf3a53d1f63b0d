"""A semantic cache: answers found by an equal prompt or by a similar one, with expiry, eviction and statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.operators.ranges import places
from heron.operators.search import batch_top_k
from heron.operators.staging import saved

#: Similarity that a hit needs at least, and how long an entry lives.
THRESHOLD, TTL_MS = 0.92, 3_600_000


def lookup(entries: DataFrame, prompts: DataFrame, threshold: float = THRESHOLD, ttl_ms: int = TTL_MS) -> DataFrame:
    """(prompt_id, entry_id, score, kind): for each prompt the entry that answers it, exact or similar; kind and entry_id are null for a miss.

    entries (entry_id, key, model_id, vector, created_ms), prompts (prompt_id, key, model_id, vector, asked_ms). An entry
    with the prompt's key and model decides alone (the one created last, ties to the greater id); if it has expired, the
    prompt misses. Other prompts get the nearest entry of their model, if it is near enough and has not expired.
    """
    last = entries.groupBy("key", "model_id").agg(F.max_by(F.struct("entry_id", "created_ms"), F.struct("created_ms", "entry_id")).alias("e"))
    met = saved(prompts.join(last, ["key", "model_id"], "left").select("prompt_id", "model_id", "vector", "asked_ms", "e"))
    fresh = lambda created: F.col("asked_ms") - created <= ttl_ms
    exact = met.where("e IS NOT NULL").select("prompt_id", F.when(fresh(F.col("e.created_ms")), F.col("e.entry_id")).alias("entry_id"), F.lit(1.0).alias("score"), F.lit("exact").alias("kind"))
    rest, near = met.where("e IS NULL"), None
    for model in [r[0] for r in entries.select("model_id").distinct().collect()]:  # embedding models: a few names
        mine = entries.where(F.col("model_id") == model)
        asked = rest.where(F.col("model_id") == model).select(F.col("prompt_id").alias("query_id"), "vector")
        best = batch_top_k(mine, asked, 1, threshold=threshold, id_col="entry_id")
        near = best if near is None else near.unionByName(best)
    found = rest.select("prompt_id", "asked_ms")
    if near is None:
        similar = found.select("prompt_id", F.lit(None).cast(entries.schema["entry_id"].dataType).alias("entry_id"), F.lit(None).cast("double").alias("score"), F.lit("similar").alias("kind"))
    else:
        near = near.join(entries.select(F.col("entry_id").alias("id"), "created_ms"), "id")
        found = found.join(near.select(F.col("query_id").alias("prompt_id"), F.col("id").alias("entry_id"), "score", "created_ms"), "prompt_id", "left")
        similar = found.select("prompt_id", F.when(fresh(F.col("created_ms")), F.col("entry_id")).alias("entry_id"), "score", F.lit("similar").alias("kind"))
    hit = F.col("entry_id").isNotNull()
    return exact.unionByName(similar).select("prompt_id", "entry_id", F.when(hit, F.col("score")).alias("score"), F.when(hit, F.col("kind")).alias("kind"))


def stats(entries: DataFrame, found: DataFrame) -> DataFrame:
    """One row: entries, hits, misses, hit_rate (0 without lookups), oldest_ms, newest_ms."""
    held = entries.agg(F.count("*").alias("entries"), F.min("created_ms").alias("oldest_ms"), F.max("created_ms").alias("newest_ms"))
    asked = found.agg(F.count("entry_id").alias("hits"), (F.count("*") - F.count("entry_id")).alias("misses"))
    rate = F.when(F.col("hits") + F.col("misses") > 0, F.col("hits") / (F.col("hits") + F.col("misses"))).otherwise(F.lit(0.0))
    return held.join(F.broadcast(asked), F.lit(True)).select("entries", "hits", "misses", rate.alias("hit_rate"), "oldest_ms", "newest_ms")


def unexpired(entries: DataFrame, now_ms: int, ttl_ms: int = TTL_MS) -> DataFrame:
    return entries.where(now_ms - F.col("created_ms") <= ttl_ms)


def touched(entries: DataFrame, found: DataFrame, prompts: DataFrame) -> DataFrame:
    """entries with accessed_ms moved on by the lookups that hit them."""
    used = found.where("entry_id IS NOT NULL").join(prompts.select("prompt_id", "asked_ms"), "prompt_id").groupBy("entry_id").agg(F.max("asked_ms").alias("used_ms"))
    return entries.join(used, "entry_id", "left").withColumn("accessed_ms", F.greatest("accessed_ms", F.coalesce("used_ms", "accessed_ms"))).drop("used_ms")


def evicted(entries: DataFrame, most: int) -> DataFrame:
    """The entries that go, least recently used first, until `most` are left."""
    placed, n = places(entries, "entry_id", "accessed_ms")
    return entries.join(placed.where(F.col("place") < n - most), "entry_id", "left_semi")


def answered(prompts: DataFrame, entries: DataFrame, answer, text_col: str = "text", **options) -> DataFrame:
    """(prompt_id, response, cached): responses from the cache (entries with a column response), and of the model `answer`, a column function, for the other prompts."""
    found = lookup(entries, prompts, **options)
    joined = prompts.join(found.select("prompt_id", "entry_id"), "prompt_id").join(entries.select("entry_id", "response"), "entry_id", "left")
    hits = joined.where("entry_id IS NOT NULL").select("prompt_id", "response", F.lit(True).alias("cached"))
    return hits.unionByName(joined.where("entry_id IS NULL").select("prompt_id", answer(F.col(text_col)).alias("response"), F.lit(False).alias("cached")))
