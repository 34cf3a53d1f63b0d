"""Connected components of a link table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.operators.staging import saved, shuffle_partitions

#: Links that a task of the component search handles at least, and those that it joins at once.
LINKS_A_TASK, LINKS_AT_ONCE = 200_000, 1 << 20


def joined(links: DataFrame) -> DataFrame:
    """links (u, v) of integers or strings with as many links as it takes: each task names what its own links join by its smallest node, (node, smallest), so links that repeat or close a circle go before any shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            both = pa.Table.from_batches(held)
            nodes = pa.concat_arrays([c for name in ("u", "v") for c in both[name].chunks]).dictionary_encode()
            order = pc.sort_indices(nodes.dictionary)
            place = np.empty(len(order), np.int64)
            place[order.to_numpy()] = np.arange(len(order))
            ends = place[nodes.indices.to_numpy()]
            root = list(range(len(order)))
            for a, b in zip(ends[: len(ends) // 2].tolist(), ends[len(ends) // 2 :].tolist()):
                while root[a] != a:
                    root[a] = a = root[root[a]]
                while root[b] != b:
                    root[b] = b = root[root[b]]
                root[max(a, b)] = min(a, b)
            for a in range(len(root)):  # a root is smaller than its nodes, so it is settled before them
                root[a] = root[root[a]]
            least, names = np.array(root), nodes.dictionary.take(order)
            of = np.flatnonzero(least != np.arange(len(root)))
            return pa.RecordBatch.from_arrays([names.take(pa.array(of)), names.take(pa.array(least[of]))], names=["u", "v"])

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= LINKS_AT_ONCE:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    return links.mapInArrow(run, links.schema)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (u, v) of one orderable type: (node, component), the component being its smallest node.

    Links of integers and strings are joined inside tasks first (see joined). Alternating large-star and small-star steps, each ending in a checkpoint, until the links are a star forest; links
    that are one from the beginning need no step. Links are few beside the rows they come from, so steps run in as many
    tasks as their counted links need. The links of a hub meet its least neighbour in a join, which adaptive execution
    splits. Nodes without an edge to another node don't appear.
    """
    high, low = F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    links, most = edges.where(F.col("u") != F.col("v")).select(high, low), shuffle_partitions(edges.sparkSession)
    if isinstance(links.schema["u"].dataType, T.IntegralType | T.StringType):
        links = saved(links)
        links = joined(links.coalesce(max(1, min(most, links.count() // LINKS_A_TASK))))
    links = saved(links.distinct())
    while True:
        n, done = _shape(links)
        tasks = max(1, min(most, n // LINKS_A_TASK))
        if done:
            break
        links = links.coalesce(tasks)
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(tasks)
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(tasks)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        links = saved(small.coalesce(tasks).distinct().coalesce(tasks))
    return saved(links.unionByName(links.select(F.col("v").alias("u"), "v")).coalesce(tasks).groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")))


def _shape(links: DataFrame) -> tuple[int, bool]:
    """The number of links, each from a node to a smaller one, and whether they are stars: each node has one link to a smaller one or only links to greater ones."""
    sides = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    nodes = sides.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    n, bad = nodes.agg(F.coalesce(F.sum("up"), F.lit(0)), F.count(F.when((F.col("up") > 1) | (F.col("up") > 0) & (F.col("down") > 0), 1))).first()
    return n, bad == 0
