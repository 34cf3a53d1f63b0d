"""Evaluation: classification, ranking and text-overlap metrics, thresholds and chunk statistics."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.functions.text import words


def confusion(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(label, prediction, n)."""
    return rows.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(F.count("*").alias("n"))


def accuracy(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return rows.agg(F.avg(F.when(F.col(label) == F.col(prediction), 1.0).otherwise(0.0)).alias("accuracy"))


def class_counts(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(class, tp, fp, fn, tn, support) of every class that is a label or a prediction."""
    c = confusion(rows, label, prediction)
    sides = F.array(F.struct(F.col("label").alias("class"), F.lit(True).alias("is_label")), F.struct(F.col("prediction").alias("class"), F.lit(False).alias("is_label")))
    hit = F.col("label") == F.col("prediction")
    each = c.select("n", hit.alias("hit"), F.explode(sides).alias("s")).select("n", "hit", "s.*")
    of = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    per = each.groupBy("class").agg(of(F.col("is_label") & F.col("hit")).alias("tp"), of(~F.col("is_label") & ~F.col("hit")).alias("fp"), of(F.col("is_label") & ~F.col("hit")).alias("fn"), of(F.col("is_label")).alias("support"))
    total = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))
    return per.join(F.broadcast(total), F.lit(True)).select("class", "tp", "fp", "fn", (F.col("total") - F.col("tp") - F.col("fp") - F.col("fn")).alias("tn"), "support")


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def class_scores(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """class_counts with precision, recall and f1."""
    c = class_counts(rows, label, prediction)
    c = c.withColumns({"precision": ratio(F.col("tp"), F.col("tp") + F.col("fp")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn"))})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(rows: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row: macro precision, recall and F1, F1 weighted by support, and micro F1."""
    c = class_scores(rows, label, prediction)
    return c.agg(
        F.avg("precision").alias("precision"), F.avg("recall").alias("recall"), F.avg("f1").alias("f1_macro"),
        ratio(F.sum(F.col("f1") * F.col("support")), F.sum("support")).alias("f1_weighted"), ratio(2 * F.sum("tp"), 2 * F.sum("tp") + F.sum("fp") + F.sum("fn")).alias("f1_micro"),
    )


def distinct_labels(rows: DataFrame, *cols: str) -> DataFrame:
    return rows.select(F.explode(F.array(*cols)).alias("label")).where("label IS NOT NULL").distinct().orderBy("label")


def mrr(ranked: DataFrame, relevant: DataFrame) -> DataFrame:
    """Mean of 1 / rank of the first relevant hit, 0 without one: ranked (query_id, rank, id), relevant (query_id, id)."""
    hits = ranked.join(relevant.select("query_id", "id").distinct(), ["query_id", "id"]).groupBy("query_id").agg(F.min("rank").alias("first"))
    queries = ranked.select("query_id").distinct()
    return queries.join(hits, "query_id", "left").agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


def ndcg(ranked: DataFrame, relevance: DataFrame, k: int) -> DataFrame:
    """(query_id, ndcg) with linear gains: ranked (query_id, rank, id), relevance (query_id, id, gain); the ideal ignores gains that aren't positive."""
    gain = F.col("gain") / F.log2(F.col("rank") + 1)
    found = ranked.where(F.col("rank") <= k).join(relevance, ["query_id", "id"], "left").groupBy("query_id").agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg"))
    best = relevance.where("gain > 0").withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain")))).where(F.col("rank") <= k)
    ideal = best.groupBy("query_id").agg(F.sum(gain).alias("idcg"))
    return found.join(ideal, "query_id", "left").select("query_id", ratio(F.col("dcg"), F.coalesce("idcg", F.lit(0.0))).alias("ndcg"))


def ngrams(text: Column, n: int) -> Column:
    """n-grams of words, joined by blanks."""
    w = words(text)
    return F.when(F.size(w) < n, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " ")))


def _overlap(pairs: DataFrame, n: int) -> DataFrame:
    """(pair_id, hits, of_candidate, of_reference): clipped n-gram matches of candidate and reference."""
    side = lambda col, one, other: pairs.select("pair_id", F.explode(ngrams(F.col(col), n)).alias("g"), F.lit(one).alias("c"), F.lit(other).alias("r"))
    counts = side("candidate", 1, 0).unionByName(side("reference", 0, 1)).groupBy("pair_id", "g").agg(F.sum("c").alias("c"), F.sum("r").alias("r"))
    return counts.groupBy("pair_id").agg(F.sum(F.least("c", "r")).alias("hits"), F.sum("c").alias("of_candidate"), F.sum("r").alias("of_reference"))


def rouge_n(pairs: DataFrame, n: int = 1) -> DataFrame:
    """(pair_id, rouge): F1 of the n-gram overlap of (pair_id, candidate, reference)."""
    o = pairs.select("pair_id").join(_overlap(pairs, n), "pair_id", "left")
    p, r = ratio(F.col("hits"), F.col("of_candidate")), ratio(F.col("hits"), F.col("of_reference"))
    return o.select("pair_id", F.coalesce(ratio(2 * p * r, p + r), F.lit(0.0)).alias("rouge"))


def bleu(pairs: DataFrame, longest: int = 4) -> DataFrame:
    """(pair_id, bleu): geometric mean of clipped precisions of 1 to `longest` words, unsmoothed, times the brevity penalty.

    pairs: (pair_id, candidate, reference), or (pair_id, candidate, references) with an array of them: an n-gram counts up
    to the greatest number that a reference has, and the penalty goes by the reference nearest in length, the first of equals.
    """
    many = F.col("references") if "references" in pairs.columns else F.array("reference")
    rows = pairs.select("pair_id", "candidate", many.alias("references"))
    c, lengths = F.size(words(F.col("candidate"))), F.transform("references", lambda r: F.size(words(r)))
    nearest = F.array_min(F.transform(lengths, lambda n, i: F.struct(F.abs(n - c).alias("d"), i.alias("i"), n.alias("n"))))["n"]
    out, logs, least = rows.select("pair_id", c.alias("c"), nearest.alias("r")), F.lit(0.0), []
    for n in range(1, longest + 1):
        own = rows.select("pair_id", F.explode(ngrams(F.col("candidate"), n)).alias("g")).groupBy("pair_id", "g").agg(F.count("*").alias("c"))
        told = rows.select("pair_id", F.posexplode("references").alias("ref", "text")).select("pair_id", "ref", F.explode(ngrams(F.col("text"), n)).alias("g")).groupBy("pair_id", "ref", "g").agg(F.count("*").alias("n"))
        most = told.groupBy("pair_id", "g").agg(F.max("n").alias("r"))
        hits = own.join(most, ["pair_id", "g"], "left").groupBy("pair_id").agg((F.sum(F.least("c", F.coalesce("r", F.lit(0)))) / F.sum("c")).alias(f"p{n}"))
        out = out.join(hits, "pair_id", "left")
        logs = logs + F.log(F.coalesce(f"p{n}", F.lit(0.0))) / longest
        least.append(F.coalesce(f"p{n}", F.lit(0.0)))
    penalty = F.when(F.col("c") >= F.col("r"), F.lit(1.0)).otherwise(F.exp(1 - F.col("r") / F.col("c")))
    return out.select("pair_id", F.when((F.col("c") == 0) | (F.array_min(F.array(*least)) == 0), F.lit(0.0)).otherwise(penalty * F.exp(logs)).alias("bleu"))


def common_length(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: the columns of the table are the bits of one number."""
    at: dict[str, int] = {}
    for i, x in enumerate(b):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(b)) - 1
    row = full  # a bit is 0 where the length goes up by one
    for x in a:
        met = row & at.get(x, 0)
        row = ((row + met) | (row - met)) & full
    return len(b) - row.bit_count()


@F.pandas_udf(T.IntegerType())
def lcs_length(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([common_length(x, y) for x, y in zip(a.map(list), b.map(list))], dtype="int32")


def rouge_l(pairs: DataFrame) -> DataFrame:
    """(pair_id, rouge): F1 of the longest common subsequence of words."""
    c, r = words(F.col("candidate")), words(F.col("reference"))
    o = pairs.select("pair_id", lcs_length(c, r).alias("l"), F.size(c).alias("c"), F.size(r).alias("r"))
    p, q = ratio(F.col("l"), F.col("c")), ratio(F.col("l"), F.col("r"))
    return o.select("pair_id", ratio(2 * p * q, p + q).alias("rouge"))


def evaluate(rows: DataFrame, predict: Column, metric: Callable[[DataFrame], DataFrame] = accuracy, label: str = "label") -> DataFrame:
    """A metric of predictions made by a column expression or UDF."""
    return metric(rows.select(F.col(label).alias("label"), predict.alias("prediction")))


def distribution(scores: DataFrame, score: str = "score") -> DataFrame:
    """One row: n, mean, median, population deviation, min, max of a score column."""
    s = F.col(score)
    return scores.agg(F.count(s).alias("n"), F.avg(s).alias("mean"), F.percentile(s, 0.5).alias("median"), F.stddev_pop(s).alias("stddev"), F.min(s).alias("min"), F.max(s).alias("max"))


def percentile_disc(p: float, score: str = "score") -> Column:
    """Nearest rank: the value at place ceil(p * n); p = 0 gives the least."""
    return F.expr(f"percentile_disc({float(p)}) WITHIN GROUP (ORDER BY {score})")


def auto_threshold(scores: DataFrame, score: str = "score") -> DataFrame:
    """Mean less one population deviation; a lone score less 0.01; 0 without scores."""
    s = F.col(score)
    n = F.count(s)
    return scores.agg(F.when(n == 0, F.lit(0.0)).when(n == 1, F.max(s) - 0.01).otherwise(F.avg(s) - F.stddev_pop(s)).alias("threshold"))


def chunk_stats(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """n_chunks, total_chars, avg_size (rounded), min_size, max_size."""
    n = F.length(text_col)
    return chunks.agg(F.count("*").alias("n_chunks"), F.coalesce(F.sum(n), F.lit(0)).alias("total_chars"), F.coalesce(F.floor(F.avg(n) + 0.5), F.lit(0)).alias("avg_size"), F.coalesce(F.min(n), F.lit(0)).alias("min_size"), F.coalesce(F.max(n), F.lit(0)).alias("max_size"))


def ingestion_estimate(docs: DataFrame, chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """One row of what an ingestion would store: documents, chunks, chars, avg_chunk (rounded); 0 without any."""
    stored = chunks.agg(F.count("*").alias("chunks"), F.coalesce(F.sum(F.length(text_col)), F.lit(0)).alias("chars"))
    given = docs.agg(F.count("*").alias("documents"))
    average = F.when(F.col("chunks") > 0, F.floor(F.col("chars") / F.col("chunks") + 0.5)).otherwise(F.lit(0))
    return given.join(F.broadcast(stored), F.lit(True)).select("documents", "chunks", "chars", average.cast("long").alias("avg_chunk"))


def estimate_chunks(length: Column, size: int = 500, overlap: int = 50) -> Column:
    return F.when(length <= 0, F.lit(0)).when(length <= size, F.lit(1)).otherwise(F.ceil(length / max(1, size - overlap)))
