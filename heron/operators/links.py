"""Links in groups of any size: what all accepted pairs of a group would join, without looking at all pairs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.operators.graph import components
from heron.operators.staging import saved, small_side


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Groups of rows that are next to each other and agree on the first `keys` columns."""
    key, rows = None, []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[:keys] != key:
                if rows:
                    yield key, rows
                key, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield key, rows


def forest(in_a: np.ndarray, in_b: np.ndarray, classes: np.ndarray, near: Callable[[int], np.ndarray], confirm: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links that join the classes of rows as all accepted pairs (a row of in_a, a row of in_b) would.

    near(a) marks the rows that may be linked with row a, confirm(a, b) decides. Pairs of one class are not looked at.
    classes (a number for each row) is changed in place.
    """
    links = []
    for a in np.flatnonzero(in_a).tolist():
        apart = in_b & (classes != classes[a])
        if not apart.any():
            continue
        for b in np.flatnonzero(near(a) & apart).tolist():
            if classes[b] != classes[a] and (confirm is None or confirm(a, b)):
                classes[classes == classes[b]] = classes[a]
                links.append((a, b))
    return links


#: Of the rows of a unit: payload columns, in_a, in_b, classes to the linked pairs of places.
Verify = Callable[[list[list], np.ndarray, np.ndarray, np.ndarray], list[tuple[int, int]]]


def unit_links(units: DataFrame, payload: list[str], verify: Verify) -> DataFrame:
    """(u, v): the links that `verify` finds in each unit, rows (group, unit, class, in_a, in_b, node, *payload) with equal group and unit; class is null for all or for none. Nodes come in their order, so groups of the same nodes are joined by the same links."""
    kind = units.schema["node"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        us, vs, node_type = [], [], None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(us, node_type), pa.array(vs, node_type)], names=["u", "v"])

        def typed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            nonlocal node_type
            for batch in source:
                node_type = batch.schema.field("node").type
                yield batch

        for _, rows in sorted_groups(typed(batches), 2):
            if len(rows) < 2:
                continue
            classes, in_a, in_b, nodes, *columns = map(list, zip(*rows))
            start = np.arange(len(rows)) if classes[0] is None else np.unique(np.array(classes), return_inverse=True)[1]
            for a, b in verify(columns, np.array(in_a), np.array(in_b), start):
                us.append(nodes[a]), vs.append(nodes[b])
            if len(us) > 10_000:
                yield out()
                us, vs = [], []
        if us:
            yield out()

    return units.select("group", "unit", "class", "in_a", "in_b", "node", *payload).repartition("group", "unit").sortWithinPartitions("group", "unit", "node").mapInArrow(run, f"u {kind}, v {kind}")


def group_links(rows: DataFrame, payload: list[str], verify: Verify, most: int, most_bytes: int = 16 << 20, weight: Column | None = None, split: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> DataFrame:
    """(u, v): links that connect the nodes of each group exactly as all its pairs accepted by `verify` would, without looking at all pairs.

    rows: (group, node, *payload), a row for each node of a group; they are read several times, so give saved ones. A
    group of up to `most` rows (and most_bytes of `weight`) is one unit of work. A larger one is dealt into blocks by a
    hash of the node:

    1. the first block meets every block, so a family of near copies, of any size, is joined by its links to a few
       members; each row of the other blocks is in one unit;
    2. only rows outside the group's largest class still matter: they meet all blocks, in blocks of their own. Where
       they are more than a block and `split` is given, it deals the group into smaller ones first: it returns the rows
       of groups that it can't split, and rows of new groups in which every accepted pair of the old ones meets again.

    No unit holds more than two blocks, so a hot group needs no large task, and no pair goes unseen.
    """
    size = F.greatest(F.ceil(F.count("*") / most), F.ceil(F.sum(weight if weight is not None else F.lit(1)) / most_bytes)).cast("int")
    large = saved(rows.groupBy("group").agg(size.alias("blocks")).where("blocks > 1"))
    some = not large.isEmpty()
    none = F.lit(None).cast("long")
    dealt = rows.join(small_side(large), "group", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))) if some else rows.withColumn("blocks", F.lit(1))
    dealt = dealt.withColumn("home", F.pmod(F.xxhash64("node", F.lit(17)), F.col("blocks")).cast("int"))
    units = dealt.withColumn("unit", F.explode(F.when(F.col("home") == 0, F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("home")))) if some else dealt.withColumn("unit", F.lit(0))
    first = unit_links(units.withColumns({"class": none, "in_a": F.col("home") == 0, "in_b": F.col("home") == F.col("unit")}), payload, verify)
    if not some:
        return first
    first = saved(first)
    classes = components(first).select("node", F.col("component").alias("found"))
    known = dealt.where("blocks > 1").join(classes, "node", "left").withColumn("class", F.xxhash64(F.coalesce("found", "node"))).drop("found")
    counts = known.groupBy("group", "class").agg(F.count("*").alias("n"), F.max("blocks").alias("blocks"))
    main = counts.groupBy("group").agg(F.max_by("class", F.struct("n", "class")).alias("main"), F.sum("n").alias("all"), F.max("n").alias("n"), F.max("blocks").alias("blocks")).where("n < all")
    main = saved(main.select("group", "main", F.ceil((F.col("all") - F.col("n")) * F.col("blocks") / F.col("all")).cast("int").alias("left_blocks")))
    known, links = known.join(small_side(main), "group"), first
    if split is not None and not (wide := saved(main.where("left_blocks > 1").select("group"))).isEmpty():
        whole, dealt_anew = split(known.join(small_side(wide), "group", "left_semi").select("group", "node", *payload))
        links = links.unionByName(group_links(saved(dealt_anew), payload, verify, most, most_bytes, weight, split))
        known = known.join(small_side(wide), "group", "left_anti").unionByName(known.join(small_side(saved(whole.select("group").distinct())), "group", "left_semi"))
    known = known.withColumns({"left": F.col("class") != F.col("main"), "left_home": F.pmod(F.xxhash64("node", F.lit(19)), F.col("left_blocks")).cast("int")})
    asks = known.where("left").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumns({"in_a": F.lit(True), "in_b": F.col("home") == F.col("block"), "left_block": F.col("left_home")})
    told = known.withColumn("left_block", F.explode(F.sequence(F.lit(0), F.col("left_blocks") - 1))).where("NOT left OR left_block != left_home").withColumns({"in_a": F.lit(False), "in_b": F.lit(True), "block": F.col("home")})
    rest = asks.unionByName(told).withColumn("unit", F.struct("left_block", "block"))
    return links.unionByName(unit_links(rest, payload, verify))
