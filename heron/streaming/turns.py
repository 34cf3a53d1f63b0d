"""Utterances and turns of a stream of conversations: keyed state machines with several state variables and timers, and the same over a table."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import astuple, dataclass, replace
from itertools import groupby

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROWS = "utterance long, kind string, chunk long, from_ms long, to_ms long, frames long, level double, truncated boolean"
#: Rows of a key that become Python objects at once.
STEP = 1 << 14
MOVES = "at long, event string, from_state string, to_state string, barge_in boolean"


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Start streams with these state machines inside: their state variables need the store that keeps column families."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


# ---- utterances -----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Listening:
    """What makes an utterance: level and time of loud frames that begin one, of quiet frames that end one, its greatest length, the time between partial rows, and the time without frames after which it is over."""

    threshold: float = -45.0
    least_ms: int = 200
    end_ms: int = 900
    cap_ms: int = 25_000
    partial_ms: int = 800
    silent_ms: int = 30_000


@dataclass
class Voice:
    """Whether someone speaks, since when frames have been loud or quiet, and the last frame."""

    speaks: bool = False
    loud_since: int | None = None
    quiet_since: int | None = None
    last: int | None = None


@dataclass
class Utterance:
    """The number of utterances begun, and of the open one: its begin (None: none is open), frames, sum of levels, partial rows and intervals that have passed."""

    begun: int = 0
    since: int | None = None
    frames: int = 0
    level: float = 0.0
    chunks: int = 0
    passed: int = 0


def _row(u: Utterance, kind: str, to: int, truncated: bool) -> tuple:
    return u.begun - 1, kind, u.chunks, u.since, to, u.frames, u.level / u.frames if u.frames else None, truncated


def silent(v: Voice, u: Utterance) -> tuple[Voice, Utterance, list[tuple]]:
    """The states after no frame has come for long, and the last row of the utterance that was open."""
    return Voice(last=v.last), Utterance(u.begun), [_row(u, "final", v.last, True)] if u.since is not None else []


def heard(v: Voice, u: Utterance, frames: Iterator[tuple[int, float]], how: Listening) -> tuple[Voice, Utterance, list[tuple]]:
    """The states after frames (time, level) in order, and the rows that they give.

    An utterance holds the frames from the one at which speech is certain to the one before its end: that at which
    quiet has lasted, or the first one at the cap, which begins the next utterance. A frame gives a partial row if a
    further interval has passed since the begin. A frame older than the last one changes nothing and is a row of its own.
    """
    v, u, out = replace(v), replace(u), []
    for t, level in frames:
        if v.last is not None and t < v.last:
            out.append((None, "late", None, t, t, 1, level, False))
            continue
        if v.last is not None and t - v.last > how.silent_ms:
            v, u, rows = silent(v, u)
            out += rows
        v.last = t
        if level >= how.threshold:
            v.quiet_since = None
            if not v.speaks:
                v.loud_since = t if v.loud_since is None else v.loud_since
                if t - v.loud_since >= how.least_ms:
                    v.speaks, v.loud_since = True, None
                    u = Utterance(u.begun + 1, t)
        else:
            v.loud_since = None
            if v.speaks:
                v.quiet_since = t if v.quiet_since is None else v.quiet_since
                if t - v.quiet_since >= how.end_ms:
                    v.speaks, v.quiet_since = False, None
                    out.append(_row(u, "final", t, False))
                    u = Utterance(u.begun)
        if u.since is None:
            continue
        if t - u.since >= how.cap_ms:
            out.append(_row(u, "final", t, True))
            u = Utterance(u.begun + 1, t)
        u.frames, u.level = u.frames + 1, u.level + level
        if (t - u.since) // how.partial_ms > u.passed:
            u.passed = (t - u.since) // how.partial_ms
            out.append(_row(u, "partial", t, False))
            u.chunks += 1
    return v, u, out


def in_order(rows: Iterator[pd.DataFrame], kinds: dict[str, pa.DataType], *by: str, step: int = STEP) -> Iterator[list[tuple]]:
    """Rows of a key in a micro-batch, sorted (equal ones stay in their order) and `step` at a time. They are held as the bytes of the columns in `kinds`, never as Python objects or whole frames."""
    held: dict[str, list[pa.Array]] = {c: [] for c in kinds}
    for frame in rows:
        for c, kind in kinds.items():
            held[c].append(pa.array(frame[c].to_numpy(), kind))
    table = pa.table({c: pa.chunked_array(held.pop(c), kind).combine_chunks() for c, kind in kinds.items()})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in by])
    for i in range(0, len(order), step):
        part = table.take(order[i : i + step])
        yield list(zip(*(part[c].to_pylist() for c in kinds)))


def _named(key: tuple, rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame([(key[0], *r) for r in rows], columns=["key", *[x.split()[0] for x in schema.split(", ")]])


class _Utterances(StatefulProcessor):
    def __init__(self, how: Listening):
        self.how = how

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.voice = handle.getValueState("voice", "speaks boolean, loud_since long, quiet_since long, last long")
        self.open = handle.getValueState("open", "begun long, since long, frames long, level double, chunks long, passed long")

    def _states(self) -> tuple[Voice, Utterance]:
        return Voice(*self.voice.get()) if self.voice.exists() else Voice(), Utterance(*self.open.get()) if self.open.exists() else Utterance()

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        v, u = self._states()
        for frames in in_order(rows, {"at_ms": pa.int64(), "level": pa.float64()}, "at_ms"):
            v, u, out = heard(v, u, iter(frames), self.how)
            yield _named(key, out, ROWS)
        self.voice.update(astuple(v)), self.open.update(astuple(u))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        self.handle.registerTimer(v.last + self.how.silent_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        v, u, out = silent(*self._states())
        self.voice.update(astuple(v)), self.open.update(astuple(u))
        yield _named(key, out, ROWS)

    def close(self) -> None:
        pass


def _kind(rows: DataFrame, by: str) -> str:
    return rows.select(by).schema[0].dataType.simpleString()


def utterances(frames: DataFrame, by: str, at: str, level: str, how: Listening = Listening(), late: str = "10 seconds") -> DataFrame:
    """(key, utterance, kind, chunk, from_ms, to_ms, frames, level, truncated) over a stream of frames; at is a timestamp.

    kind is partial, final or late (see heard). A key without frames for silent_ms, by the watermark, has its open
    utterance closed by a timer as `heard` does when a frame comes after such a gap, so both give the same rows. Frames
    behind the watermark are dropped. Start the stream inside state_store().
    """
    rows = frames.select(F.col(by).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("at_ms"), F.col(level).cast("double").alias("level"))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Utterances(how), f"key {_kind(frames, by)}, {ROWS}", "Append", "EventTime")


def utterances_of(frames: DataFrame, by: str, at: str, level: str, how: Listening = Listening()) -> DataFrame:
    """The same of a table; an utterance that is open at its end has no final row. The frames of a key are one sequence and one task, which Spark sorts and Python reads batch by batch. Frames without a time are left out."""
    rows = frames.where(F.col(at).isNotNull()).select(F.col(by).alias("key"), F.unix_millis(at).alias("at_ms"), F.col(level).cast("double").alias("level"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, u, before = Voice(), Utterance(), None
        for batch in batches:
            keys = batch["key"].to_pylist()
            levels = batch["level"].to_numpy(zero_copy_only=False)
            pairs = zip(keys, batch["at_ms"].to_pylist(), levels.tolist())
            for key, run_of in groupby(pairs, lambda x: x[0]):
                if (key,) != before:
                    v, u, before = Voice(), Utterance(), (key,)
                v, u, out = heard(v, u, ((t, x) for _, t, x in run_of), how)
                if out:
                    kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.float64(), pa.bool_()]
                    columns = [pa.array([key] * len(out), batch.schema.field("key").type), *[pa.array(c, t) for c, t in zip(zip(*out), kinds)]]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", *[x.split()[0] for x in ROWS.split(", ")]])

    return rows.repartition("key").sortWithinPartitions("key", "at_ms").mapInArrow(run, f"key {_kind(frames, by)}, {ROWS}")


# ---- turns ----------------------------------------------------------------------------------------------------------

#: What an event leads to from a state; other pairs change nothing. The user's speech, and an interruption, break into planning and speaking.
TURNS = {("idle", "start"): "listening", ("listening", "utterance"): "planning", ("planning", "response"): "speaking", ("speaking", "spoken"): "listening"}
TURNS |= {(state, event): "listening" for state in ("planning", "speaking") for event in ("speech", "interrupt")}
TURNS |= {(state, event): to for state in ("listening", "planning", "speaking", "error") for event, to in (("stop", "idle"), ("error", "error")) if state != to}


def moved(state: str, since: int, at: int, event: str, limit_ms: int) -> tuple[str, int, list[tuple]]:
    """The state after an event and since when it holds, with the moves: a plan that takes longer than limit_ms has failed first."""
    out = []
    if state == "planning" and at > since + limit_ms:
        since, (state, out) = since + limit_ms, ("error", [(since + limit_ms, "timeout", "planning", "error", False)])
    to = TURNS.get((state, event))
    if to is not None:
        out.append((at, event, state, to, event in ("speech", "interrupt")))
        state, since = to, at
    return state, since, out


class _Turns(StatefulProcessor):
    def __init__(self, limit_ms: int):
        self.limit_ms = limit_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("state", "state string, since long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, since = self.state.get() if self.state.exists() else ("idle", 0)
        for events in in_order(rows, {"at_ms": pa.int64(), "place": pa.int64(), "event": pa.large_string()}, "at_ms", "place"):
            out = []
            for at, _, event in events:
                state, since, found = moved(state, since, at, event, self.limit_ms)
                out += found
            yield _named(key, out, MOVES)
        self.state.update((state, since))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if state == "planning":
            self.handle.registerTimer(since + self.limit_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, since, out = moved(*self.state.get(), timerValues.getCurrentWatermarkInMs() + 1, "", self.limit_ms)
        self.state.update((state, since))
        yield _named(key, out, MOVES)

    def close(self) -> None:
        pass


def turns(events: DataFrame, by: str, at: str, place: str, event: str, limit_ms: int = 30_000, late: str = "10 seconds") -> DataFrame:
    """(key, at, event, from_state, to_state, barge_in): the moves of each conversation between idle, listening, planning, speaking and error, over a stream.

    Events (see TURNS) are taken in the order of their time and `place` within a micro-batch. A plan without response
    for limit_ms is a move to error: by a timer once the watermark is there, or by the next event. Start the stream inside state_store().
    """
    rows = events.select(F.col(by).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("at_ms"), F.col(place).alias("place"), F.col(event).alias("event"))
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Turns(limit_ms), f"key {_kind(events, by)}, {MOVES}", "Append", "EventTime")
