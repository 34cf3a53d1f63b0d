"""Audit of how document filters interact: failure masks, duplicates by partition refinement, and what each filter removes in every order."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import saved, small_side, table, written

#: The filters, in the order of their bits.
FILTERS = "ABCDE"
#: Code points of the first block; each next one is twice as long. Rows of a class that meet in one task when texts are compared, about.
BLOCK, PART = 1024, 500


def failures(text: Column) -> list[Column]:
    """Whether a text (not null) fails A (under 200 words), B (under half of its words distinct), C (over 3 % of A-Z) and D (one of # $ % & * |)."""
    words = F.col("words")
    return [
        F.size(words) < 200,
        100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        text.rlike(r"[#$%&*|]"),
    ]


def block_hashes(text: Column, first: int) -> Column:
    """Hashes of successive blocks of a text, of first, 2 * first, 4 * first ... code points, so that their number follows the logarithm of the length."""
    n = F.when(F.length(text) == 0, 1).otherwise(F.ceil(F.log2(F.length(text) / first + 1))).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: F.xxhash64(F.substring(text, (F.lit(first) * (F.pow(F.lit(2.0), k) - 1) + 1).cast("int"), (F.lit(first) * F.pow(F.lit(2.0), k)).cast("int"))))


def measured(docs: DataFrame, id_col: str, text_col: str, part_col: str, first: int) -> DataFrame:
    """(id, text_key, part, mask of A to D, n_chars, hashes): slim rows, one for each row of docs."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("words", F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), 0))
    mask = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(F.col("text")))), F.lit(0))
    return rows.select("id", F.xxhash64("text").alias("text_key"), "part", mask.alias("mask"), F.length("text").alias("n_chars"), block_hashes(F.col("text"), first).alias("hashes"))


def refined(rows: DataFrame) -> DataFrame:
    """(id, text_key, class, n): rows, once for each id and text, that agree with another id's on length and every block hash; n rows are in a class.

    Classes are those of equal lengths first and are split by one block after the other. After each step rows that
    stand alone leave, so later steps read what may still be copies. Rows without id can't be compared and leave first.
    """
    left = rows.where("id IS NOT NULL").select("id", "text_key", F.xxhash64("n_chars").alias("class"), "hashes").dropDuplicates(["id", "text_key"])
    done, k = None, 0
    while True:
        sizes = left.groupBy("class").agg(F.min("id").alias("a"), F.max("id").alias("b"), F.count("*").alias("n")).where("a != b").select("class", "n")
        left = saved(left.drop("n").join(small_side(saved(sizes)), "class"))
        whole = left.where(F.size("hashes") == k).select("id", "text_key", "class", "n")
        done = whole if done is None else done.unionByName(whole)
        left = left.where(F.size("hashes") > k)
        if left.isEmpty():
            return done
        left, k = left.withColumn("class", F.xxhash64("class", F.col("hashes")[k])), k + 1


def repeats(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text_key) of the rows of classes whose whole text is that of a smaller id.

    The text of a class's smallest id goes to the others, which are dealt to tasks by salt; those that equal it are
    marked, the few whose hashes agreed by chance are a class of their own and go on.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    members, found = written(texts.join(small_side(saved(classes)), ["id", "text_key"])), None
    while True:
        parts = F.ceil(F.col("n") / PART).cast("int")
        firsts = members.groupBy("class").agg(F.min(F.struct("id", "text_key")).alias("first")).select("class", F.col("first.id").alias("id"), F.col("first.text_key").alias("text_key"))
        heads = members.join(small_side(saved(firsts)), ["class", "id", "text_key"], "left_semi").dropDuplicates(["class"])
        heads = heads.select("class", F.col("id").alias("head"), F.col("text").alias("whole"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("salt"))
        met = members.withColumn("salt", F.pmod(F.xxhash64("id"), parts).cast("int")).join(heads, ["class", "salt"])
        marks = saved(met.select("id", "text_key", "head", (F.col("text") == F.col("whole")).alias("same")))
        new = marks.where("same AND id != head").select("id", "text_key").distinct()
        found = new if found is None else found.unionByName(new)
        others = saved(marks.where("NOT same").select("id", "text_key").distinct())
        if others.isEmpty():
            return found
        members = written(members.join(small_side(others), ["id", "text_key"], "left_semi"))


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang", first: int = BLOCK) -> DataFrame:
    """(id, part, mask, good, toxic): a row for each row of docs; bit k of mask says that it fails filter k, E being a text that a smaller id has too."""
    rows = written(measured(docs, id_col, text_col, part_col, first))
    copies = saved(repeats(docs, refined(rows), id_col, text_col))
    marked = rows.drop("n_chars", "hashes").join(small_side(copies.withColumn("copy", F.lit(True))), ["id", "text_key"], "left")
    judged = labels.groupBy(F.col("doc_id").alias("id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic")).where("id IS NOT NULL AND (good OR toxic)")
    found = marked.join(judged, "id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return found.select("id", "part", (F.col("mask") + F.when(F.col("copy"), 1 << FILTERS.index("E")).otherwise(0)).alias("mask"), yes(F.col("good")).alias("good"), yes(F.col("toxic")).alias("toxic"))


def orders() -> Column:
    """Every step of every order of the filters, as an array: order, step, the step's filter, and the sets of filters before and after it as masks."""
    steps = []
    for order in permutations(range(len(FILTERS))):
        before = 0
        for step, k in enumerate(order, 1):
            values = {"filter_order": "".join(FILTERS[i] for i in order), "step": step, "filter": FILTERS[k], "bit": 1 << k, "before": before, "after": before | 1 << k}
            steps.append(F.struct(*[F.lit(v).alias(name) for name, v in values.items()]))
            before |= 1 << k
    return F.array(*steps)


def interactions(marked: DataFrame) -> DataFrame:
    """(part, filter_order, step, filter, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for the rows of `masks`.

    Rows are counted by part and mask, which is at most 32 rows a part; what passes a set of filters is the sum over
    the masks apart from it, so each step of each order is a difference of two such sums. Parts are rows, all 600
    steps of a part come from one of them; zeros are rows too. An empty table has no parts and gives no rows.
    """
    every = 1 << len(FILTERS)
    counts = marked.groupBy("part", "mask").agg(F.count("*").alias("n"), F.count(F.when(F.col("good"), 1)).alias("good"), F.count(F.when(F.col("toxic"), 1)).alias("toxic"))
    passing = lambda c: F.array(*[F.sum(F.when(F.col("mask").bitwiseAND(s) == 0, F.col(c)).otherwise(0)) for s in range(every)])
    exact = F.array(*[F.sum(F.when(F.col("mask") == s, F.col("n")).otherwise(0)) for s in range(every)])
    parts = counts.groupBy("part").agg(passing("n").alias("n"), passing("good").alias("good"), passing("toxic").alias("toxic"), exact.alias("exact"))
    steps = parts.withColumn("at", F.explode(orders()))
    before, after, bit = F.col("at.before"), F.col("at.after"), F.col("at.bit")
    lost = lambda c: F.get(c, before) - F.get(c, after)
    rows = steps.select(
        "part", "at.filter_order", "at.step", "at.filter", F.get("n", after).alias("kept"), lost("n").alias("removed"),
        (F.get("n", F.lit(0)) - F.get("n", bit) - lost("n")).alias("redundant"), F.get("exact", bit).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"),
    )
    shares = rows.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return rows.join(shares, ["part", "filter"])


def audited(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """What every filter removes, from which rows, in every order, for each part of docs: see `interactions`.

    A null text is an empty one and a null part the empty string. A row without id is no copy and no original and has
    no label; rows that repeat an id and text are judged alike, and are no copies of each other; of several labels of
    an id the worst and the best count both. Whole texts are read, a very long one in one row; its block hashes grow
    with the logarithm of its length. An empty table gives no rows. Other columns, whatever their names, are ignored.
    """
    return interactions(masks(docs, labels, id_col, text_col, part_col))


def query(spark, sf_dir: str) -> DataFrame:
    """Contract of operator 12."""
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


SQL = r"""
WITH t AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
f AS (SELECT part, len(w) < 200 AS a, 100 * len(list_distinct(w)) < 50 * len(w) AS b, 100 * len(regexp_extract_all(text, '[A-Z]')) > 3 * length(text) AS c, regexp_matches(text, '[#$%&*|]') AS d,
  coalesce(doc_id > min(doc_id) OVER (PARTITION BY text), false) AS e, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good, doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1) AS toxic FROM t),
m AS (SELECT part, [a, b, c, d, e] AS fails, good, toxic, count(*) AS n FROM f GROUP BY ALL),
l AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 3, 4, 5]) AS i),
o AS (SELECT p.x || q.x || r.x || s.x || t.x AS filter_order, [p.i, q.i, r.i, s.i, t.i] AS bits FROM l p, l q, l r, l s, l t WHERE len(list_distinct([p.i, q.i, r.i, s.i, t.i])) = 5),
k AS (SELECT filter_order, unnest([1, 2, 3, 4, 5]) AS step, bits FROM o),
z AS (SELECT part, filter_order, step, filter_order[step] AS filter, fails[bits[step]] AS failing, list_contains(list_transform(bits[1:step - 1], lambda j: fails[j]), true) AS gone, len(list_filter(fails, lambda y: y)) AS n_fails, good, toxic, n FROM m, k),
g AS (SELECT part, filter_order, step, filter, coalesce(sum(n) FILTER (NOT gone AND NOT failing), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND failing), 0) AS removed, coalesce(sum(n) FILTER (gone AND failing), 0) AS redundant,
  coalesce(sum(n) FILTER (failing AND n_fails = 1), 0) AS unique_fails, coalesce(sum(n) FILTER (NOT gone AND failing AND good), 0) AS good_lost, coalesce(sum(n) FILTER (NOT gone AND failing AND toxic), 0) AS toxic_lost FROM z GROUP BY ALL)
SELECT part, filter_order, step, filter, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, filter))::BIGINT AS shapley FROM g
"""
