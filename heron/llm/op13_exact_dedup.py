"""Exact dedup by deterministic block naming, in DataFrame functions only: blocks, then pairs of names, get integer names until a document has one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heron.llm.common import saved, shuffle_partitions, small_side, table, written

#: Code points of a block.
BLOCK = 1024
#: Occurrences of one block or pair that are sorted in one group, at most; a more frequent one is salted. A table with few rows is salted sooner.
MOST, LEAST = 10_000, 256
#: The name that stands behind the last block of an odd count; names are not negative.
NONE = -1


def normalised(text: Column) -> Column:
    """text with each run of white space replaced by one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def named(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with `name`, the smallest `ref` among the rows with equal keys, and `n`, their number; the keys themselves are dropped.

    rows: (ref long, unique; hash long, equal for equal keys; keys; others), written or saved ones, as they are read twice.
    Rows are sorted by their keys, whose whole values decide. How often a hash occurs is counted first: keys of frequent
    ones are sorted in salted parts of about MOST rows, and the parts' names are then sorted among themselves. So no key,
    however frequent, is one group, and the hash decides about work only.
    """
    within, all_rows = Window.partitionBy(*keys), rows.count()
    most = max(LEAST, min(MOST, all_rows // (4 * shuffle_partitions(rows.sparkSession))))
    hot = None
    if all_rows > most:
        hot = saved(rows.groupBy("hash").agg(F.count("*").alias("n")).where(F.col("n") > most).select("hash", F.ceil(F.col("n") / most).cast("int").alias("parts")))
    if hot is None or hot.isEmpty():
        return rows.withColumns({"name": F.min("ref").over(within), "n": F.count("*").over(within)}).drop(*keys, "hash")
    part = F.when(F.col("parts").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64("ref"), F.col("parts")).cast("int"))
    salted = Window.partitionBy(*keys, "part")
    first = rows.join(small_side(hot), "hash", "left").withColumn("part", part).withColumns({"name": F.min("ref").over(salted), "n": F.count("*").over(salted)})
    found = written(first.withColumns({k: F.when(F.col("parts").isNotNull() & (F.col("ref") == F.col("name")), F.col(k)) for k in keys}).withColumn("hot", F.col("parts").isNotNull()).drop("hash", "parts", "part"))
    parts = found.where("hot AND ref = name")
    whole = saved(parts.select(F.col("name").alias("part_name"), F.min("name").over(within).alias("whole_name"), F.sum("n").over(within).alias("whole_n")))
    joined = found.join(small_side(whole), F.col("name") == F.col("part_name"), "left")
    return joined.withColumns({"name": F.coalesce("whole_name", "name"), "n": F.coalesce("whole_n", "n")}).drop(*keys, "hot", "part_name", "whole_name", "whole_n")


def blocks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(ref, row, at, id, text_sha256, hash, block): the blocks of each normalised text; `row` names the row of docs; its id and digest stand at its first block. An empty text is one empty block."""
    text = normalised(F.col(text_col).cast("string"))
    cut = docs.select(F.col(id_col).alias("id"), text.alias("text")).withColumn("row", F.monotonically_increasing_id())
    pieces = F.when(F.col("text") == "", F.array(F.lit(""))).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{size}}}"), 0))
    first = F.col("at") == 0
    return cut.select("row", "id", F.sha2("text", 256).alias("text_sha256"), F.posexplode(pieces).alias("at", "block")).select(
        F.monotonically_increasing_id().alias("ref"), "row", "at", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("text_sha256")).alias("text_sha256"), F.xxhash64("block").alias("hash"), "block"
    )


def identities(cells: DataFrame) -> DataFrame:
    """(row, level, name): one integer name for the rows that may have an equal; two rows have equal texts if and only if they have equal levels and names.

    cells: (ref, row, at, hash, block). A round names the blocks, then pairs of neighbouring names, an odd last one
    being paired with NONE. A row with a name that no other place has is equal to no other row: it leaves, without
    identity. A row with one name left has its identity, the level being the round. Rounds follow the logarithm of the
    longest text in blocks and read rows that still have several names.
    """
    level, keys, done = 0, ["block"], None
    state = cells.select("ref", "row", "at", "hash", "block")
    while True:
        now = saved(named(state, keys))
        rows = now.groupBy("row").agg(F.min("n").alias("least"), F.count("*").alias("names"), F.min("name").alias("name")).where("least > 1")
        rows = saved(rows)
        whole = rows.where("names = 1").select("row", F.lit(level).alias("level"), "name")
        done = whole if done is None else done.unionByName(whole)
        left = rows.where("names > 1").select("row")
        if left.isEmpty():
            return done
        pairs = now.join(small_side(left), "row", "left_semi").withColumns({"pair": F.expr("at div 2").cast("int"), "first": F.col("at") % 2 == 0}).groupBy("row", F.col("pair").alias("at"))
        state = pairs.agg(F.min("ref").alias("ref"), F.max(F.when(F.col("first"), F.col("name"))).alias("a"), F.coalesce(F.max(F.when(~F.col("first"), F.col("name"))), F.lit(NONE)).alias("b"))
        state, keys, level = saved(state.withColumn("hash", F.xxhash64("a", "b"))), ["a", "b"], level + 1


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """A row for each row of docs: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Texts are equal when they are identical after each run of white space became one space; null is empty. Of equal
    texts the row with the smallest id stays (kept); a row without id stands behind all others. Of rows that repeat a
    text and its smallest id just one is kept. Whole texts decide, by the names of their blocks: hashes choose where
    blocks are sorted, never what is equal. Ids are of any type with an order. A very long text is one row until it is
    cut. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    cells = written(blocks(docs, id_col, text_col, size))
    heads = cells.where("at = 0").select("row", "id", "text_sha256")
    known = saved(identities(cells))
    order = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    groups = heads.join(known, "row").groupBy("level", "name").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    groups = saved(groups.select("level", "name", F.col("first.id").alias("keep_id"), F.col("first.row").alias("keep_row"), "group_size"))
    marks = known.join(small_side(groups), ["level", "name"]).drop("level", "name")
    found = heads.join(marks, "row", "left")
    alone = F.col("keep_row").isNull()
    return found.select(
        "id",
        F.when(alone, F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("row") == F.col("keep_row"))).alias("kept"),
        "text_sha256",
    )


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = BLOCK) -> DataFrame:
    """docs without the rows whose text equals, but for white space, that of a row with a smaller id; of ids that repeat such a text, all rows of the smallest stay. Columns are those of docs."""
    marks = exact_duplicates(docs, id_col, text_col, size).where("group_size > 1 AND NOT id <=> keep_id").select("id", "text_sha256").distinct()
    rows = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("key"), F.sha2(normalised(F.col(text_col).cast("string")), 256).alias("digest"))
    gone = rows.join(small_side(saved(marks)), F.col("key").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("text_sha256")), "left_anti")
    return gone.select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 13."""
    return exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


SQL = r"""
WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS whole FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY whole) AS group_size, row_number() OVER w = 1 AS kept, sha256(whole) AS text_sha256 FROM t
WINDOW w AS (PARTITION BY whole ORDER BY doc_id NULLS LAST)
"""
