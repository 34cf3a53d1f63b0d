"""A token bucket for each key of a stream of requests."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from heron.operators.logs import refilled


def token_bucket(requests: DataFrame, by: str, at: str, key: str, most: float, refill: float, every_ms: int) -> DataFrame:
    """(by, key, at, allowed, tokens), as operators.logs.token_bucket, over a stream: the state of a key is its tokens and the time of their last refill.

    Requests of a key are handled in the order of `at` and `key` within a micro-batch; one that is older than the last
    refill takes from the tokens that are there.
    """
    kinds = dict(requests.dtypes)

    def run(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values(["at", "key"])
        tokens, since = state.get if state.exists else (float(most), int(rows["at"].iloc[0]))
        out = []
        for k, t in zip(rows["key"].tolist(), rows["at"].tolist()):
            tokens, since = refilled(tokens, since, t, most, refill, every_ms)
            ok = tokens >= 1
            tokens -= ok
            out.append((group[0], k, t, ok, tokens))
        state.update((float(tokens), int(since)))
        yield pd.DataFrame(out, columns=["by", "key", "at", "allowed", "tokens"])

    rows = requests.select(F.col(by).alias("by"), F.col(key).alias("key"), F.col(at).cast("long").alias("at"))
    return rows.groupBy("by").applyInPandasWithState(run, f"by {kinds[by]}, key {kinds[key]}, at long, allowed boolean, tokens double", "tokens double, since long", "append", GroupStateTimeout.NoTimeout)
