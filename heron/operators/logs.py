"""Log analytics: statistics, sliding windows, sessions, retention and eviction, hash chains, histories, change logs."""

from __future__ import annotations

import hashlib
import math
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.operators.ranges import lagged, places


def millis(ts: Column) -> Column:
    return F.unix_millis(ts.cast("timestamp"))


def log_stats(logs: DataFrame, state: Column, received: Column, sent: Column, duration: Column) -> DataFrame:
    """One row of totals: requests, completed, failed, bytes and durations of completed ones, bytes a second."""
    done = state == "completed"
    of = lambda x: F.coalesce(F.sum(F.when(done, x)), F.lit(0.0))
    out = logs.agg(F.count("*").alias("requests"), F.count(F.when(done, 1)).alias("completed"), F.count(F.when(state == "failed", 1)).alias("failed"), of(received).alias("received"), of(sent).alias("sent"), of(duration).alias("duration"))
    return out.withColumn("speed", F.when(F.col("duration") > 0, F.col("received") / F.col("duration") * 1000).otherwise(0.0))


def breakdowns(logs: DataFrame, sets: list[list[str]], **measures: Column) -> DataFrame:
    """Several groupings in one pass (GROUPING SETS); columns outside a row's grouping are null, grouping_id tells them apart."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    return logs.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(F.grouping_id().cast("long").alias("grouping"), *[m.alias(n) for n, m in measures.items()])


def trailing_count(logs: DataFrame, ts: str, window_ms: int, *by: str) -> DataFrame:
    """logs with n_recent: rows of the same key in the window_ms up to and with each row."""
    w = Window.partitionBy(*by).orderBy(millis(F.col(ts))).rangeBetween(-window_ms, 0)
    return logs.withColumn("n_recent", F.count("*").over(w))


def rate_limited(logs: DataFrame, ts: str, limit: int, window_ms: int, *by: str) -> DataFrame:
    """logs with `allowed`: at most `limit` rows in any trailing window of the key, by what came in (not by what was let through)."""
    return trailing_count(logs, ts, window_ms, *by).withColumn("allowed", F.col("n_recent") <= limit)


def last_minute(logs: DataFrame, ts: str) -> DataFrame:
    """One row: requests in the 60 s before the latest one."""
    latest = logs.agg(F.max(millis(F.col(ts))).alias("latest"))
    return logs.join(F.broadcast(latest), millis(F.col(ts)) >= F.col("latest") - 60_000).agg(F.count("*").alias("n"))


def sessions(logs: DataFrame, by: str, ts: str, gap_ms: int) -> DataFrame:
    """(key, session, start_ms, end_ms, n): runs of a key's rows with no gap of more than gap_ms."""
    rows = logs.select(F.col(by).alias("key"), millis(F.col(ts)).alias("at"))
    w = Window.partitionBy("key").orderBy("at")
    new = F.when(F.col("at") - F.lag("at").over(w) > gap_ms, 1).otherwise(0)
    return rows.withColumn("new", new).withColumn("session", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).groupBy("key", "session").agg(F.min("at").alias("start_ms"), F.max("at").alias("end_ms"), F.count("*").alias("n"))


def voice_activity(frames: DataFrame, by: str, at: str, level: str, threshold: float = -45.0, least_ms: int = 200, end_ms: int = 900) -> DataFrame:
    """(key, at, kind, level): speech starts once the level has been at the threshold or above for least_ms, and ends once it has been below for end_ms.

    Runs of loud and of quiet frames are islands; the first frame of a run that is old enough is a candidate, and of
    successive candidates of one kind the first counts. The streaming twin is streaming.voice.
    """
    w = Window.partitionBy("key").orderBy("at")
    rows = frames.select(F.col(by).alias("key"), F.col(at).alias("at"), F.col(level).alias("level"), (F.col(level) >= threshold).alias("loud"))
    turn = F.when(F.col("loud") == F.lag("loud").over(w), 0).otherwise(1)
    rows = rows.withColumn("turn", turn).withColumn("run", F.sum("turn").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    began = F.first("at").over(Window.partitionBy("key", "run").orderBy("at"))
    old = rows.withColumn("age", F.col("at") - began).where((F.col("loud") & (F.col("age") >= least_ms)) | (~F.col("loud") & (F.col("age") >= end_ms)))
    firsts = old.withColumn("nth", F.row_number().over(Window.partitionBy("key", "run").orderBy("at"))).where("nth = 1")
    last = F.lag("loud").over(w)
    turns = firsts.withColumn("last", last).where((F.col("last").isNull() & F.col("loud")) | (F.col("last") != F.col("loud")))
    return turns.select("key", "at", F.when(F.col("loud"), "start").otherwise("end").alias("kind"), "level")


def running_before(rows: DataFrame, by: str | None, value: str, *order: Column) -> Column:
    """Sum of value over the earlier rows of the key."""
    w = Window.partitionBy(by) if by else Window.partitionBy()
    return F.coalesce(F.sum(value).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def evicted(rows: DataFrame, by: str, size: str, used: str, key: str, needed: int, active: DataFrame | None = None) -> DataFrame:
    """Least recently used rows of each store until `needed` bytes are free; rows in `active` (by key) stay."""
    rows = rows if active is None else rows.join(active, key, "left_anti")
    return rows.withColumn("freed_before", running_before(rows, by, size, F.asc(used), F.asc(key))).where(F.col("freed_before") < needed)


def evicted_all(rows: DataFrame, size: str, used: str, key: str, needed: int, buckets: int = 256) -> DataFrame:
    """The same for one store of any size, without a window over all of it.

    Bytes are summed by ranges of `used` first (approximate quantiles); whole ranges go while they fit, and only the
    range where the limit falls is sorted.
    """
    cuts = rows.select(F.percentile_approx(used, [i / buckets for i in range(1, buckets)], 10 * buckets).alias("q")).first().q or []
    cuts = sorted(set(cuts))
    slot = slot_of(F.col(used), cuts)
    placed = rows.withColumn("slot", slot)
    sums = placed.groupBy("slot").agg(F.sum(size).alias("bytes"))
    w = Window.partitionBy(F.lit(0)).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.withColumn("before", F.coalesce(F.sum("bytes").over(w), F.lit(0))).where(F.col("before") < needed).select("slot", "before")  # `buckets` rows at most
    inside = placed.join(F.broadcast(starts), "slot")
    own = Window.partitionBy("slot").orderBy(F.asc(used), F.asc(key)).rowsBetween(Window.unboundedPreceding, -1)
    return inside.withColumn("freed_before", F.col("before") + F.coalesce(F.sum(size).over(own), F.lit(0))).where(F.col("freed_before") < needed).drop("slot", "before")


def slot_of(value: Column, cuts: list) -> Column:
    """How many of the sorted cuts are no greater than the value: first whole blocks of about the square root of their number are counted, then the cuts of one block."""
    if not cuts:
        return F.lit(0)
    size = math.isqrt(len(cuts)) + 1
    count = lambda among: F.aggregate(among, F.lit(0), lambda n, c: n + (c <= value).cast("int"))
    whole = count(F.lit(cuts[size - 1 :: size])) if len(cuts) >= size else F.lit(0)
    return whole * size + count(F.slice(F.lit(cuts), whole * size + 1, F.lit(size)))


def expired(rows: DataFrame, created: str, key: str, cutoff_ms: int | None = None, usage_percent: float | None = None, keep_least: int = 0) -> DataFrame:
    """Rows to remove, oldest first: those older than the cutoff, or the oldest share beyond usage_percent; keep_least rows stay. The two rules exclude each other."""
    placed, n = places(rows, key, created)
    most = max(0, n - keep_least)
    if cutoff_ms is not None:
        old = rows.where(millis(F.col(created)) < cutoff_ms)
        return old.join(placed.where(F.col("place") < most), key, "left_semi")
    share = int(n * max(0.0, 100 - (100.0 if usage_percent is None else usage_percent)) / 100)
    return rows.join(placed.where(F.col("place") < min(share, most)), key, "left_semi")


def truncated(turns: DataFrame, by: str, order: str, text: str, context: int, reserved: int = 0) -> DataFrame:
    """The newest turns of each conversation whose tokens (a quarter of the characters, rounded up) fit in 0.8 of the context less the reserved ones."""
    room = int(context * 0.8) - reserved
    tokens = F.ceil(F.length(text) / 4)
    w = Window.partitionBy(by).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("tokens", tokens).withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= room)


def newest(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The n first rows of each key in the given order (memory eviction, ring buffers)."""
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where(F.col("nth") <= n).drop("nth")


def repeated_runs(rows: DataFrame, by: str, order: str, value: str, least: int = 2) -> DataFrame:
    """(key, first, last, value, n): runs of at least `least` equal values in a row."""
    w = Window.partitionBy("key").orderBy("at")
    x = rows.select(F.col(by).alias("key"), F.col(order).alias("at"), F.col(value).alias("value"))
    new = F.when(F.col("value").eqNullSafe(F.lag("value").over(w)) & F.lag("at").over(w).isNotNull(), 0).otherwise(1)
    runs = x.withColumn("new", new).withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy("key", "run", "value").agg(F.min("at").alias("first"), F.max("at").alias("last"), F.count("*").alias("n")).where(F.col("n") >= least).drop("run")


def chain_body(*fields: Column) -> Column:
    """The fields of an entry as canonical JSON (fixed key order)."""
    return F.to_json(F.struct(*[f.alias(f"f{i}") for i, f in enumerate(fields)]), {"ignoreNullFields": "false"})


def chain_hash(previous: Column, body: Column) -> Column:
    """SHA-256 in hex of the previous hash (empty for the first entry) and the body."""
    return F.sha2(F.concat(F.coalesce(previous, F.lit("")), body), 256)


def chained(rows: DataFrame, by: str, order: str, body: str) -> DataFrame:
    """rows with previous_hash and hash: in each chain every hash covers the one before it.

    A chain is sequential, so its rows stream through one task in their order, with constant memory; chains are made in
    parallel, and verified (chain_verdict) row by row.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("previous_hash", T.StringType()), T.StructField("hash", T.StringType())])
    key_at, body_at = rows.columns.index(by), rows.columns.index(body)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, last = object(), None
        for batch in batches:
            before, own = [], []
            for k, text in zip(batch.column(key_at).to_pylist(), batch.column(body_at).to_pylist()):
                if k != key:
                    key, last = k, None
                before.append(last)
                last = hashlib.sha256(((last or "") + (text or "")).encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*batch.schema.names, "previous_hash", "hash"])

    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(run, schema)


def token_bucket(rows: DataFrame, by: str, at: str, key: str, most: float, refill: float, every_ms: int, cost: str | None = None) -> DataFrame:
    """rows with allowed and tokens (left after the row): a bucket of `most` tokens for each key gets `refill` tokens for each whole every_ms since its last refill.

    Rows of a key are handled in the order of `at` (milliseconds) and `key`, in one task with constant memory. The
    streaming twin is streaming.limits.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType()), T.StructField("tokens", T.DoubleType())])
    by_at, at_at, cost_at = rows.columns.index(by), rows.columns.index(at), rows.columns.index(cost) if cost else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None  # key, tokens, last refill
        for batch in batches:
            n = batch.num_rows
            allowed, left = [], []
            for k, t, c in zip(batch.column(by_at).to_pylist(), batch.column(at_at).to_pylist(), batch.column(cost_at).to_pylist() if cost else [1] * n):
                if state is None or state[0] != k:
                    state = (k, float(most), t)
                tokens, since = refilled(state[1], state[2], t, most, refill, every_ms)
                ok = tokens >= c
                state = (k, tokens - c if ok else tokens, since)
                allowed.append(ok), left.append(state[1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_()), pa.array(left, pa.float64())], names=[*batch.schema.names, "allowed", "tokens"])

    return rows.repartition(by).sortWithinPartitions(by, at, key).mapInArrow(run, schema)


def refilled(tokens: float, since: int, now: int, most: float, refill: float, every_ms: int) -> tuple[float, int]:
    """Tokens and time of the last refill once `now` is there."""
    whole = (now - since) // every_ms
    return (min(most, tokens + whole * refill), now) if whole > 0 else (tokens, since)


def logged(df: DataFrame, name: str):
    """df that counts its rows while a job runs, and the Observation that holds the count once the job has ended."""
    from pyspark.sql import Observation

    seen = Observation(name)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def chain_verdict(entries: DataFrame, seq: str, previous: str, own: str, recomputed: Column, by: str | None = None) -> DataFrame:
    """(key, checked, broken_at, reason): the first entry of each chain whose link or hash is wrong; null if all is well.

    An entry is checked against the one before it, through ranges (ranges.lagged), so one chain of any length is many
    tasks; hashes are recomputed row by row.
    """
    key = F.col(by) if by else F.lit(0)
    rows = entries.select(key.alias("key"), F.col(seq).alias("seq"), F.col(previous).alias("previous"), F.col(own).alias("own"), (recomputed == F.col(own)).alias("fits"))
    link = F.col("previous").eqNullSafe(F.col("before"))
    rows = lagged(rows, "own", "before", "key", "seq").withColumn("reason", F.when(~link, "previous hash").when(~F.col("fits"), "hash"))
    broken = F.min(F.when(F.col("reason").isNotNull(), F.struct("seq", "reason")))
    return rows.groupBy("key").agg(F.count("*").alias("checked"), broken.alias("b")).select("key", "checked", F.col("b.seq").alias("broken_at"), F.col("b.reason").alias("reason"))


def committed(log: DataFrame, txn: str, kind: str, commit: str = "commit", rollback: str = "rollback") -> DataFrame:
    """The entries of transactions that were committed and not rolled back, without the entries that say so; entries of no transaction (null) count as committed.

    Only the transactions' verdicts, one row each, are joined to the log.
    """
    said = log.where(F.col(kind).isin(commit, rollback)).groupBy(F.col(txn).alias("__txn")).agg((F.max((F.col(kind) == commit).cast("int")) - F.max((F.col(kind) == rollback).cast("int")) == 1).alias("__done"))
    entries = log.where(~F.col(kind).isin(commit, rollback))
    return entries.join(said, F.col(txn) == F.col("__txn"), "left").where(F.col(txn).isNull() | F.coalesce("__done", F.lit(False))).select(*log.columns)


def replayed(log: DataFrame, txn: str, order: str, key: str, kind: str, delete: str = "delete") -> DataFrame:
    """The state after the committed entries of a log are applied in their order."""
    return compacted(committed(log, txn, kind), key, order, kind, delete)


def admitted(rows: DataFrame, by: str, at: str, key: str, limit: int, window_ms: int) -> DataFrame:
    """rows with allowed: at most `limit` allowed rows of a key in any trailing window; refused ones don't count.

    Rows of a key are handled in the order of `at` (milliseconds) and `key`; a task holds the times of `limit` rows.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("allowed", T.BooleanType())])
    by_at, at_at = rows.columns.index(by), rows.columns.index(at)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, times = object(), deque(maxlen=limit)
        for batch in batches:
            allowed = []
            for k, t in zip(batch.column(by_at).to_pylist(), batch.column(at_at).to_pylist()):
                if k != current:
                    current, times = k, deque(maxlen=limit)
                ok = len(times) < limit or t - times[0] >= window_ms
                if ok:
                    times.append(t)
                allowed.append(ok)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(allowed, pa.bool_())], names=[*batch.schema.names, "allowed"])

    return rows.repartition(by).sortWithinPartitions(by, at, key).mapInArrow(run, schema)


def compacted(changes: DataFrame, key: str, order: str, kind: str, delete: str = "delete") -> DataFrame:
    """State after a change log: the last change of each key, unless it is a deletion."""
    last = changes.groupBy(F.col(key)).agg(F.max_by(F.struct(*[F.col(c) for c in changes.columns if c != key]), F.col(order)).alias("last"))
    return last.select(key, "last.*").where(F.col(kind) != delete)
