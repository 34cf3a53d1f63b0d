"""Global row numbers, predecessors and running sums without a window over everything: ranges, and what they hand to the next one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron.operators.staging import saved


def places(rows: DataFrame, key: str, *order: str) -> tuple[DataFrame, int]:
    """(key, place) of rows, as `numbered`, and their number: only the key and the columns of the order are sorted and written. The key must be unique; join the few places that are wanted."""
    placed, n = numbered(rows.select(*dict.fromkeys([*order, key])), *dict.fromkeys([*order, key]))
    return placed.select(key, "place"), n


def numbered(rows: DataFrame, *order: str) -> tuple[DataFrame, int]:
    """rows with `place`, gapless from 0 in the given order, and their number.

    Rows are range-partitioned and sorted; the low bits of monotonically_increasing_id number them within a
    partition, and the partitions' counts (a row each) are summed on the driver. The sorted rows are checkpointed, so
    that both passes see the same ranges.
    """
    placed = rows.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = saved(placed)
    starts, n = [], 0
    for part, count in sorted(tuple(r) for r in placed.groupBy("__part").count().collect()):
        starts.append((part, n))
        n += count
    sums = rows.sparkSession.createDataFrame(starts, "__part int, __start long")
    return placed.join(F.broadcast(sums), "__part").withColumn("place", F.col("__at") + F.col("__start")).drop("__part", "__at", "__start"), n


def ranged(rows: DataFrame, by: str | None, order: str) -> DataFrame:
    """rows with `__key` (that of by, or 0 for one sequence) and `__part`, the number of their range of key and order; a checkpoint, so that ranges stay the same."""
    keyed = rows.withColumn("__key", F.col(by) if by else F.lit(0))
    return saved(keyed.repartitionByRange("__key", order).withColumn("__part", F.spark_partition_id()))


def lagged(rows: DataFrame, value: str, name: str, by: str | None, order: str) -> DataFrame:
    """rows with `name`, the value of the row before in the order (unique within by); null for the first of a sequence.

    A sequence of any length is dealt into ranges. Within a range a window finds the row before; the last value of each
    range, a row for each, goes to the first row of the next range of the same sequence.
    """
    placed = ranged(rows, by, order)
    inside = Window.partitionBy("__key", "__part").orderBy(order)
    ends = placed.groupBy("__key", "__part").agg(F.max_by(F.struct(value), order).alias("__end"))
    handed = ends.select(F.col("__key").alias("__of"), F.col("__part").alias("__at"), F.lag("__end").over(Window.partitionBy("__key").orderBy("__part")).alias("__end"))
    met = placed.withColumns({"__before": F.lag(F.struct(value)).over(inside), "__first": F.row_number().over(inside) == 1})
    met = met.join(handed, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__at")))
    return met.withColumn(name, F.when(F.col("__first"), F.col("__end")).otherwise(F.col("__before"))[value]).drop("__key", "__part", "__before", "__first", "__end", "__of", "__at")


def running_vectors(rows: DataFrame, vector: str, by: str | None, order: str) -> DataFrame:
    """(by, order, vector): for each row the sum of its vector and of all before it in the order.

    Each range sums by itself, a window for each dimension; the sums of whole ranges, a row for each range and dimension, are added up and
    handed on.
    """
    columns = [by, order] if by else [order]
    parts = ranged(rows.select(*columns, vector), by, order).select(*columns, "__key", "__part", F.posexplode(vector).alias("__i", "__d"))
    totals = parts.groupBy("__key", "__part", "__i").agg(F.sum("__d").alias("__sum"))
    before = F.sum("__sum").over(Window.partitionBy("__key", "__i").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    handed = totals.select(F.col("__key").alias("__of"), F.col("__part").alias("__at"), F.col("__i").alias("__dim"), F.coalesce(before, F.lit(0.0)).alias("__start"))
    running = F.sum("__d").over(Window.partitionBy("__key", "__part", "__i").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    met = parts.withColumn("__x", running).join(handed, F.col("__key").eqNullSafe(F.col("__of")) & (F.col("__part") == F.col("__at")) & (F.col("__i") == F.col("__dim")))
    met = met.select(*columns, F.col("__i").alias("i"), (F.col("__x") + F.col("__start")).alias("x"))
    return met.groupBy(*columns).agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("vector"))


def median(rows: DataFrame, column: str) -> DataFrame:
    """One row (median): the exact one, the mean of the two middle values of an even number; null without values. Values are counted, then dealt into ranges, of which only those that hold the middle are numbered."""
    counted = ranged(rows.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("__value")).agg(F.count("*").alias("__n")), None, "__value")
    sums, starts, n = sorted(tuple(r) for r in counted.groupBy("__part").agg(F.sum("__n")).collect()), [], 0  # a row for each range
    total = sum(x for _, x in sums)
    low, high = (total - 1) // 2, total // 2
    for part, x in sums:
        if n <= high and n + x > low:
            starts.append((part, n))
        n += x
    middle = counted.join(F.broadcast(rows.sparkSession.createDataFrame(starts, "__part int, __start long")), "__part")
    end = F.col("__start") + F.sum("__n").over(Window.partitionBy("__part").orderBy("__value"))
    middle = middle.withColumn("__end", end).where((F.col("__end") > low) & (F.col("__end") - F.col("__n") <= high))
    return middle.agg(((F.min("__value") + F.max("__value")) / 2).alias("median"))
