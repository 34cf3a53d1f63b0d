"""Event-time windows over streams; rows later than the watermark are dropped. The same calls work on batches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rates(logs: DataFrame, ts: str, size: str = "1 minute", slide: str | None = None, late: str = "10 minutes", *by: str) -> DataFrame:
    """(start, end, keys, n): rows in tumbling or sliding windows."""
    w = F.window(F.col(ts), size, slide) if slide else F.window(F.col(ts), size)
    return logs.withWatermark(ts, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def sessions(logs: DataFrame, by: str, ts: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(key, start, end, n): sessions that end after a gap."""
    out = logs.withWatermark(ts, late).groupBy(F.session_window(F.col(ts), gap).alias("w"), F.col(by).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def unique(rows: DataFrame, keys: list[str], ts: str, late: str = "10 minutes") -> DataFrame:
    """The first row of each key within the watermark (a cache of recent prompts, a change feed without repeats)."""
    return rows.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)
