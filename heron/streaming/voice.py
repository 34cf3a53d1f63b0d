"""Voice activity as a keyed state machine, and utterances made of it."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def voice_activity(frames: DataFrame, by: str, at: str, level: str, threshold: float = -45.0, least_ms: int = 200, end_ms: int = 900) -> DataFrame:
    """(key, at, kind, level), as operators.logs.voice_activity, over a stream: the state of a key is whether it speaks and since when it has been loud or quiet.

    Frames of a key are handled in the order of `at` within a micro-batch. A frame older than the last one handled can't
    change what was decided: it gives a row of kind late.
    """
    kind = frames.select(by).schema[0].dataType.simpleString()

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        speaks, loud_since, quiet_since, last = state.get if state.exists else (False, None, None, None)
        rows = pd.concat(list(batches)).sort_values("at")
        out = []
        for t, x in zip(rows["at"].tolist(), rows["level"].tolist()):
            if last is not None and t < last:
                out.append((key[0], t, "late", x))
                continue
            last = t
            if x >= threshold:
                quiet_since = None
                if not speaks:
                    loud_since = t if loud_since is None else loud_since
                    if t - loud_since >= least_ms:
                        speaks, loud_since = True, None
                        out.append((key[0], t, "start", x))
            else:
                loud_since = None
                if speaks:
                    quiet_since = t if quiet_since is None else quiet_since
                    if t - quiet_since >= end_ms:
                        speaks, quiet_since = False, None
                        out.append((key[0], t, "end", x))
        state.update((speaks, loud_since, quiet_since, last))
        yield pd.DataFrame(out, columns=["key", "at", "kind", "level"])

    rows = frames.select(F.col(by).alias("key"), F.col(at).alias("at"), F.col(level).alias("level"))
    return rows.groupBy("key").applyInPandasWithState(run, f"key {kind}, at long, kind string, level double", "speaks boolean, loud_since long, quiet_since long, last long", "append", GroupStateTimeout.NoTimeout)
