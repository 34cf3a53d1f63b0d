"""Chunk sizes against a plain restatement of the rules, digests against hmac, and odd inputs of the capacity operators."""

import hmac
import random

from heron.functions import canonical, chunking
from heron.operators import capacity
from pyspark.sql import functions as F


def by_hand(breaks, similarities, lengths, most, least):
    """The rules on lists of segments."""
    size = lambda g: sum(lengths[i] for i in g) + len(g) - 1
    groups = [[0]]
    for i in range(1, len(lengths)):
        groups.append([i]) if breaks[i - 1] else groups[-1].append(i)

    def split(g):
        if size(g) <= most or len(g) == 1:
            return [g]
        k = min(range(len(g) - 1), key=lambda j: (similarities[g[j]], j)) + 1
        return split(g[:k]) + split(g[k:])

    groups = [x for g in groups for x in split(g)]
    while len(groups) > 1 and (short := [i for i, g in enumerate(groups) if size(g) < least]):
        i = short[0]
        left = i > 0 and (i == len(groups) - 1 or similarities[groups[i - 1][-1]] >= similarities[groups[i][-1]])
        a = i - 1 if left else i
        groups[a : a + 2] = [groups[a] + groups[a + 1]]
    return [k for k, g in enumerate(groups) for _ in g]


def test_resized():
    draw = random.Random(5)
    for _ in range(500):
        n = draw.randint(1, 14)
        lengths, similarities = [draw.randint(0, 60) for _ in range(n)], [draw.choice([0.1, 0.5, draw.random()]) for _ in range(n)]
        breaks = [draw.random() < 0.4 for _ in range(n - 1)]
        assert chunking.resized(breaks, similarities, lengths, 80, 30) == by_hand(breaks, similarities, lengths, 80, 30)


def test_canonical(spark):
    texts = ["", "a", "ä" * 100, None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for key in (b"k", b"long" * 40):
        got = [r[0] for r in rows.select(canonical.hmac_sha256(key, F.col("t"))).collect()]
        assert [None if x is None else bytes(x) for x in got] == [None if t is None else hmac.digest(key, t.encode(), "sha256") for t in texts]
    odd = spark.createDataFrame([('{"b": 1, "a": {"d": null, "c": [2, 1]}}',), ("not json",), (None,)], "t string")
    assert [r[0] for r in odd.select(canonical.canonical_json(F.col("t"))).collect()] == ['{"a":{"c":[2,1],"d":null},"b":1}', None, None]
    levels = spark.createDataFrame([(1.0,), (0.0,), (1e-30,), (None,)], "x double").select(canonical.decibels(F.col("x")))
    assert [r[0] for r in levels.collect()] == [0.0, -200.0, -200.0, -200.0]


def test_capacity_empty(spark):
    none = spark.createDataFrame([], "state string, ms long, meta string")
    assert tuple(capacity.queue_stats(none, F.col("state"), F.col("ms")).first()) == (0, 0, 0, 0, 0)
    assert tuple(capacity.cleanup_estimate(none, F.col("ms")).first()) == (0, 0)
    assert capacity.metadata_keys(none, F.col("meta")).count() == 0
    odd = spark.createDataFrame([(None,), ("[1]",), ('{"a": 1, "b": 2}',), ('{"a": null}',)], "meta string")
    assert sorted(map(tuple, capacity.metadata_keys(odd, F.col("meta"), ("b",)).collect())) == [("a", 2)]
