"""A semantic cache over a stream of prompts: lookups and stores in one keyed operator, whose entries live for a time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from heron.operators.cache import THRESHOLD, TTL_MS
from heron.streaming.turns import in_order

FOUND = "prompt_id long, at long, kind string, entry_id long, score double, entries long"


@dataclass
class Entry:
    entry_id: int
    created: int
    used: int
    vector: list[float] | None


def answer(entries: dict[str, Entry], prompt: str, prompt_id: int, at: int, vector: list[float] | None, threshold: float, ttl_ms: int, most: int) -> tuple[str, int | None, float | None]:
    """(kind, entry_id, score) of a prompt, which is stored if it misses; entries are changed in place.

    Entries older than ttl_ms are gone. An entry of the same prompt is an exact hit; else the nearest one, ties to the
    smaller id, is a similar hit if it is near enough; else the prompt becomes an entry, and the least recently used
    ones go until `most` are left.
    """
    for p in [p for p, e in entries.items() if at - e.created > ttl_ms]:
        del entries[p]
    if prompt in entries:
        entries[prompt].used = max(at, entries[prompt].used)
        return "exact", entries[prompt].entry_id, 1.0
    near = [e for e in entries.values() if e.vector is not None] if vector is not None else []
    if near:
        held, v = np.array([e.vector for e in near], np.float64), np.array(vector, np.float64)
        sizes = np.linalg.norm(held, axis=1) * np.linalg.norm(v)
        scores = np.round(np.divide(held @ v, sizes, out=np.zeros(len(near)), where=sizes > 0), 9)
        best = min(range(len(near)), key=lambda i: (-scores[i], near[i].entry_id))
        if scores[best] >= threshold:
            near[best].used = max(at, near[best].used)
            return "similar", near[best].entry_id, float(scores[best])
    entries[prompt] = Entry(prompt_id, at, at, vector)
    while len(entries) > most:
        del entries[min(entries, key=lambda p: (entries[p].used, entries[p].entry_id))]
    return "miss", None, None


class _Cache(StatefulProcessor):
    def __init__(self, threshold: float, ttl_ms: int, most: int):
        self.threshold, self.ttl_ms, self.most = threshold, ttl_ms, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.entries = handle, handle.getMapState("entries", "prompt string", "entry_id long, created long, used long, vector array<double>")

    def _held(self) -> dict[str, Entry]:
        return {k[0]: Entry(v[0], v[1], v[2], None if v[3] is None else list(v[3])) for k, v in self.entries.iterator()} if self.entries.exists() else {}

    def _keep(self, before: dict[str, tuple], now: dict[str, Entry]) -> None:
        """Write what has changed, and wake up when the oldest entry has lived its time."""
        for p in before.keys() - now.keys():
            self.entries.removeKey((p,))
        for p, e in now.items():
            if before.get(p) != (e.entry_id, e.used):
                self.entries.updateValue((p,), (e.entry_id, e.created, e.used, e.vector))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if now:
            self.handle.registerTimer(min(e.created for e in now.values()) + self.ttl_ms + 1)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self._held()
        before = {p: (e.entry_id, e.used) for p, e in held.items()}
        names = ["key", *[x.split()[0] for x in FOUND.split(", ")]]
        for asked in in_order(rows, {"at_ms": pa.int64(), "prompt_id": pa.int64(), "prompt": pa.large_string(), "vector": pa.large_list(pa.float64())}, "at_ms", "prompt_id"):
            out = []
            for at, i, prompt, vector in asked:
                kind, entry, score = answer(held, prompt, i, at, vector, self.threshold, self.ttl_ms, self.most)
                out.append((key[0], i, at, kind, entry, score, len(held)))
            yield pd.DataFrame(out, columns=names).astype({"entry_id": "Int64"})
        self._keep(before, held)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, now = self._held(), timerValues.getCurrentWatermarkInMs()
        self._keep({p: (e.entry_id, e.used) for p, e in held.items()}, {p: e for p, e in held.items() if now - e.created <= self.ttl_ms})
        yield pd.DataFrame()

    def close(self) -> None:
        pass


def cached(prompts: DataFrame, by: str, at: str, prompt_id: str, prompt: str, vector: str, threshold: float = THRESHOLD, ttl_ms: int = TTL_MS, most: int = 1000, late: str = "10 seconds") -> DataFrame:
    """(key, prompt_id, at, kind, entry_id, score, entries): exact, similar or miss for each prompt of a stream, and how many entries its model then has.

    The state of a key (a model) is a map of at most `most` entries, each with its prompt, vector and times; prompts are
    taken in the order of time and id within a micro-batch (see answer). Entries leave the state when the watermark has
    passed their time, by a timer, also where no prompt comes any more. Start the stream inside turns.state_store().
    """
    rows = prompts.select(F.col(by).alias("key"), F.col(at).alias("at"), F.unix_millis(at).alias("at_ms"), F.col(prompt_id).cast("long").alias("prompt_id"), F.coalesce(F.col(prompt), F.lit("")).alias("prompt"), F.col(vector).cast("array<double>").alias("vector"))
    kind = prompts.select(by).schema[0].dataType.simpleString()
    return rows.withWatermark("at", late).groupBy("key").transformWithStateInPandas(_Cache(threshold, ttl_ms, most), f"key {kind}, {FOUND}", "Append", "EventTime")
