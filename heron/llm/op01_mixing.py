"""Mixing sources to target weights by Poisson replication, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import table

#: Shares of the mixture's bytes; the sources that aren't named share the rest in proportion to their sizes.
WEIGHTS = {"src0": 0.2, "src1": 0.06, "src2": 0.06}
REST = 0.68
SEED = 20
#: A rate above this is drawn as the sum of equal smaller ones, so that exp(-rate) never vanishes.
PART = 16.0
#: Terms of the distribution function; beyond them, at a rate of PART, less than 2^-60 is left.
TERMS = 80


def uniform(*parts: Column) -> Column:
    """[0, 1) with 52 bits from the MD5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def distribution(mean: float, terms: int = TERMS) -> list[float]:
    """P(count <= k) of a Poisson count for k = 0 to terms."""
    p = total = math.exp(-mean)
    sums = [total]
    for k in range(1, terms + 1):
        p *= mean / k
        total += p
        sums.append(total)
    return sums


def replicated(docs: DataFrame, weights: dict[str, float] = WEIGHTS, rest: float = REST, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED, total: float | None = None) -> DataFrame:
    """(doc, copy, n_copies, shuffle_key): rows of docs, as a struct, replicated so that sources have their target shares of the bytes.

    A source's mean repetition rate is weight * total / bytes, `total` being the bytes of the mixture (that of docs if
    not given) and weights being normed over the sources that are there; those not named, and null, are one source of
    weight `rest`. Each document draws its count by inverting the Poisson distribution function at a uniform number
    hashed from seed and id, so a rerun, a lost executor or another partitioning gives the same mixture. A document is
    exploded by its count and the rows are shuffled globally by a hash of document and copy: each partition holds a
    random share in random order, and ordering by shuffle_key gives one global permutation.

    Only the bytes of the named sources and of the rest, a row each, are gathered; the rates become constants of the
    plan, so no join is needed and a hot source needs no care. Null texts have no bytes, yet are drawn; a source without any
    bytes has rate 0. Rows that repeat an id draw the same count, null ids draw by their text. Texts of any length are
    only measured and moved. An empty table gives no rows. Columns of docs may have any names.
    """
    named = sorted(weights)
    source, text = F.col(source_col).cast("string"), F.col(text_col).cast("string")
    bucket = F.coalesce(*[F.when(source == s, F.lit(i)) for i, s in enumerate(named)], F.lit(-1))  # the rest: -1
    size = F.coalesce(F.sum(F.octet_length(text)), F.lit(0))
    sizes = {x.bucket: x.bytes for x in docs.groupBy(bucket.alias("bucket")).agg(size.alias("bytes")).collect() if x.bytes}  # a row for each named source and the rest
    shares = {i: float(weights[named[i]] if i >= 0 else rest) for i in sizes}
    whole, sums, parts = total or sum(sizes.values()), F.lit(None).cast("array<double>"), F.lit(None).cast("int")
    for i in sizes:
        rate = shares[i] / sum(shares.values()) * whole / sizes[i]
        n = max(1, math.ceil(rate / PART))
        sums, parts = F.when(F.col("bucket") == i, F.lit(distribution(rate / n))).otherwise(sums), F.when(F.col("bucket") == i, F.lit(n)).otherwise(parts)

    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("text:"), F.md5(F.coalesce(text, F.lit("")))))
    drawn = docs.select(F.struct("*").alias("doc"), bucket.alias("bucket"), key.alias("key")).select("doc", "key", sums.alias("sums"), parts.alias("parts")).where("parts IS NOT NULL")
    draws = F.transform(F.sequence(F.lit(1), F.col("parts")), lambda j: uniform(F.lit(str(seed)), F.col("key"), j.cast("string")))
    count = F.aggregate(draws, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("sums"), lambda s: s <= u)))
    counted = drawn.select("doc", "key", count.alias("n_copies")).where("n_copies > 0")
    copies = counted.select("doc", "key", "n_copies", F.explode(F.sequence(F.lit(0), F.col("n_copies") - 1)).alias("copy"))
    shuffle = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}s"), "key", F.col("copy").cast("string"))), 1, 13), 16, 10).cast("long")
    return copies.select("doc", "copy", "n_copies", shuffle.alias("shuffle_key")).repartition("shuffle_key").sortWithinPartitions("shuffle_key")


ADDED = ("copy", "n_copies", "shuffle_key")


def mixed(docs: DataFrame, *args, **options) -> DataFrame:
    """replicated() with the columns of docs and copy (from 0), n_copies and shuffle_key, which take the place of columns of these names."""
    out = replicated(docs, *args, **options)
    return out.select(*[F.col("doc").getField(c).alias(c) for c in docs.columns if c.lower() not in ADDED], *ADDED)


def query(spark, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


SQL = f"""
WITH sizes AS (
    SELECT bucket, bytes, CASE bucket {' '.join(f"WHEN '{s}' THEN CAST({w} AS DOUBLE)" for s, w in sorted(WEIGHTS.items()))} ELSE CAST({REST} AS DOUBLE) END AS share
    FROM (SELECT CASE WHEN source IN ({', '.join(f"'{s}'" for s in sorted(WEIGHTS))}) THEN source ELSE '*' END AS bucket, sum(strlen(text)) AS bytes FROM documents GROUP BY 1)
    WHERE bytes > 0
),
rates AS (SELECT bucket, share / (SELECT sum(share) FROM sizes) * (SELECT sum(bytes) FROM sizes) / bytes AS rate FROM sizes),
terms AS (
    SELECT bucket, k, sum(exp(k * ln(rate) - rate - lgamma(k + 1))) OVER (PARTITION BY bucket ORDER BY k) AS upto
    FROM rates, (SELECT unnest(range({TERMS + 1})) AS k)
),
drawn AS (
    SELECT *, ('0x' || substr(md5('{SEED}:' || doc_id || ':1'), 1, 13))::BIGINT / CAST({1 << 52} AS DOUBLE) AS u, CASE WHEN source IN ({', '.join(f"'{s}'" for s in sorted(WEIGHTS))}) THEN source ELSE '*' END AS bucket
    FROM documents
),
counted AS (
    SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, CAST(count(*) FILTER (t.upto <= d.u) AS INTEGER) AS n_copies
    FROM drawn d JOIN terms t ON d.bucket = t.bucket GROUP BY ALL
)
SELECT doc_id, text, lang, source, n_chars, n_copies, CAST(copy AS INTEGER) AS copy, ('0x' || substr(md5('{SEED}s:' || doc_id || ':' || copy), 1, 13))::BIGINT AS shuffle_key
FROM (SELECT *, unnest(range(n_copies)) AS copy FROM counted)
"""
