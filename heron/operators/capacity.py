"""Sizes, counts and orders that decide on capacity: queues, clean-up estimates, batch sizes, metadata keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.operators.ranges import numbered


def queue_stats(jobs: DataFrame, state: Column, latency_ms: Column) -> DataFrame:
    """One row: pending, active, completed, failed, avg_latency_ms. The latency of completed and failed jobs is divided by the completed ones and rounded; without any it is 0."""
    count = lambda s: F.count(F.when(state == s, 1))
    done = F.coalesce(F.sum(F.when(state.isin("completed", "failed"), latency_ms)), F.lit(0))
    average = F.when(count("completed") > 0, F.floor(done / count("completed") + F.lit(0.5))).otherwise(F.lit(0))
    return jobs.agg(*[count(s).alias(s) for s in ("pending", "active", "completed", "failed")], average.cast("long").alias("avg_latency_ms"))


def cleanup_estimate(removed: DataFrame, size: Column) -> DataFrame:
    """One row of a dry run: the rows that a clean-up would remove, and their bytes."""
    return removed.agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("bytes"))


def batch_size(base: Column, cores: Column, memory_gb: Column, gpu: Column, least: int, most: int, gpu_factor: float) -> Column:
    """Batch size that grows with cores and memory against 4 cores and 8 GB, by a factor with a GPU, within bounds."""
    raw = F.floor(base * (cores / 4) * (memory_gb / 8) * F.when(gpu, F.lit(gpu_factor)).otherwise(F.lit(1.0)))
    return F.greatest(F.lit(least), F.least(F.lit(most), raw)).cast("long")


def by_priority(jobs: DataFrame, priority: str, arrival: str) -> DataFrame:
    """jobs with `place` from 0 in the order in which they are served: by priority, then first come first served."""
    return numbered(jobs, priority, arrival)[0]


def metadata_keys(rows: DataFrame, metadata: Column, special: tuple[str, ...] = ()) -> DataFrame:
    """(key, n): keys of JSON metadata that aren't special columns, and the rows that have them."""
    keys = rows.select(F.explode(F.json_object_keys(metadata)).alias("key"))
    return keys.where(~F.col("key").isin(*special)).groupBy("key").agg(F.count("*").alias("n"))


def sentiment_stats(rows: DataFrame, label: Column, score: Column) -> DataFrame:
    """One row: n, positive, negative, neutral, avg_score."""
    count = lambda s: F.count(F.when(label == s, 1)).alias(s)
    return rows.agg(F.count("*").alias("n"), count("positive"), count("negative"), count("neutral"), F.avg(score).alias("avg_score"))


#: Shares of the parts of a model's score, and scores of its tiers; other tiers have 50.
FIT, QUALITY, SPEED = 0.5, 0.3, 0.2
QUALITY_TIERS = {"high": 100, "medium": 60, "low": 30}
SPEED_TIERS = {"fast": 100, "medium": 60, "slow": 30}


def recommended(models: DataFrame, task: str, storage_mb: float, memory_mb: float | None = None, gpu: bool = False, mobile: bool = False, k: int = 5, where: Column | None = None) -> DataFrame:
    """The k best models of a task that fit a device, with score: (model_id, task, size_mb, memory_mb, device, quality, speed) and further columns.

    Models that need more storage or memory than there is are left out. The score (0 to 100, halves rounded up) weighs
    how well a model fits (room left, device), its quality tier and its speed tier; ties go to the smaller model_id.
    """
    rows = models.where((F.col("task") == task) & (F.col("size_mb") <= storage_mb))
    rows = rows if memory_mb is None else rows.where(F.col("memory_mb").isNull() | (F.col("memory_mb") <= memory_mb))
    rows = rows if where is None else rows.where(where)
    part = F.col("size_mb") / storage_mb
    storage = F.when(part <= 0.1, 40).when(part <= 0.3, 30).when(part <= 0.6, 20).otherwise(10)
    share = F.lit(None) if memory_mb is None else F.col("memory_mb") / memory_mb
    memory = F.when(share.isNull(), 15).when(share <= 0.25, 30).when(share <= 0.5, 20).otherwise(10)
    device = F.when(F.col("device") == "gpu", F.lit(30 if gpu else 5)).when(F.col("device") == "wasm", 25).otherwise(20)
    tier = lambda c, known: F.coalesce(*[F.when(F.col(c) == name, F.lit(x)) for name, x in known.items()], F.lit(50))
    speed = F.when(F.lit(mobile) & (F.col("speed") == "fast"), 100).otherwise(tier("speed", SPEED_TIERS))
    score = F.floor(FIT * F.least(F.lit(100), storage + memory + device) + QUALITY * tier("quality", QUALITY_TIERS) + SPEED * speed + 0.5)
    return rows.withColumn("score", score.cast("long")).orderBy(F.desc("score"), "model_id").limit(k)
