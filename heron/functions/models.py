"""Model interfaces: any function from a list of texts to vectors or labels becomes an Arrow UDF; offline defaults need no files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.functions import vectors as V
from heron.functions.text import tokens

Embed = Callable[[list[str]], np.ndarray]


def hashing_embedding(texts: list[str], dimensions: int = 256) -> np.ndarray:
    """Unit vectors of signed hashed word counts: the deterministic default of embed()."""
    words = [text.lower().split() for text in texts]
    new = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
    h = np.fromiter(map(xxhash.xxh64_intdigest, new), np.uint64, len(new))
    at = np.fromiter(map(new.__getitem__, chain.from_iterable(words)), np.int64, sum(map(len, words)))
    slot = np.repeat(np.arange(len(texts)) * dimensions, list(map(len, words))) + ((h >> np.uint64(1)) % np.uint64(dimensions)).astype(np.int64)[at]
    out = np.bincount(slot, np.where(h & np.uint64(1), 1.0, -1.0)[at], len(texts) * dimensions).reshape(len(texts), dimensions).astype(np.float32)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def embed(model: Embed = hashing_embedding, batch: int = 32, retries: int = 2, *wrappers: Callable[[Embed], Embed]) -> Callable[[Column], Column]:
    """A text column to array<float>: the model is called with up to `batch` texts and called again if it fails; null texts stay null.

    wrappers are applied to the model one after the other (caching, logging, noise, redaction before embedding).
    """
    for w in wrappers:
        model = w(model)

    def call(texts: list[str]) -> np.ndarray:
        for left in range(retries, -1, -1):
            try:
                return model(texts)
            except Exception:
                if not left:
                    raise
        raise AssertionError

    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out: list[np.ndarray | None] = [None] * len(texts)
            known = np.flatnonzero(texts.notna())
            for i in range(0, len(known), batch):
                at = known[i : i + batch]
                for k, v in zip(at, call([texts.iloc[j] for j in at])):
                    out[k] = np.asarray(v, np.float32)
            yield pd.Series(out, dtype=object)

    return run


def redacting(model: Embed, **options) -> Embed:
    """A wrapper for embed(): the model sees texts with their personal data replaced (see text.redact)."""
    from heron.functions.text import redact_plain

    return lambda texts: model([redact_plain(t, **options) for t in texts])


def noisy(sigma: float, seed: int = 7) -> Callable[[Embed], Embed]:
    """A wrapper: Gaussian noise on every dimension, drawn from a hash of the text, so that a rerun gives the same vectors."""

    def wrap(model: Embed) -> Embed:
        def run(texts: list[str]) -> np.ndarray:
            v = np.asarray(model(texts), np.float64)
            draws = [np.random.default_rng([seed, xxhash.xxh64_intdigest(t)]).standard_normal(v.shape[1]) for t in texts]
            return v + sigma * np.stack(draws) if len(texts) else v

        return run

    return wrap


def cached(most: int = 10_000) -> Callable[[Embed], Embed]:
    """A wrapper: vectors of the last `most` texts of a Python worker are kept, and the model is called for the others only, each once."""

    def wrap(model: Embed) -> Embed:
        held: dict[str, np.ndarray] = {}

        def run(texts: list[str]) -> np.ndarray:
            new = [t for t in dict.fromkeys(texts) if t not in held]
            found = dict(zip(new, model(new))) if new else {}
            out = np.stack([found[t] if t in found else held[t] for t in texts])
            held.update(found)
            while len(held) > most:
                held.pop(next(iter(held)))
            return out

        return run

    return wrap


def embedded_once(rows: DataFrame, embedder: Callable[[Column], Column], text_col: str = "text") -> DataFrame:
    """rows with `vector`, the embedder being called once for each different text."""
    texts = rows.select(F.col(text_col).alias("text")).where("text IS NOT NULL").distinct()
    vectors = texts.select(F.md5("text").alias("key"), embedder(F.col("text")).alias("vector"))
    return rows.withColumn("key", F.md5(text_col)).join(vectors, "key", "left").drop("key")


#: Similarity from which texts mean the same, by model.
THRESHOLDS = {
    "Xenova/bge-small-en-v1.5": 0.5, "Xenova/bge-base-en-v1.5": 0.5, "Xenova/all-MiniLM-L6-v2": 0.68, "Xenova/all-MiniLM-L12-v2": 0.7, "nomic-ai/nomic-embed-text-v1.5": 0.55,
    "Xenova/gte-small": 0.6, "Xenova/gte-base": 0.6, "Xenova/e5-small-v2": 0.6, "Xenova/paraphrase-MiniLM-L6-v2": 0.72,
}


def default_threshold(model_id: Column) -> Column:
    """The similarity threshold of a known model, else null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in THRESHOLDS.items() for x in pair]), model_id)


def compatibility(collections: DataFrame, model_id: str, provider: str, dimensions: int) -> DataFrame:
    """collections (collection_id, model_id, provider, dimensions, n) with status: compatible (also where no model is known), dimension-mismatch or incompatible."""
    other = (F.col("model_id") != model_id) | (F.col("provider") != provider)
    status = F.when(F.col("model_id").isNull(), "compatible").when(F.col("dimensions") != dimensions, "dimension-mismatch").when(other, "incompatible").otherwise("compatible")
    return collections.withColumn("status", status)


def nearest_class(rows: DataFrame, labelled: DataFrame, vector_col: str = "vector") -> DataFrame:
    """(id, label, score): each row's label by the nearest mean vector of the labelled rows (vector, label); ties go to the smaller label.

    Means are grouped sums over all labelled rows; a row for each label is sent to the tasks.
    """
    parts = labelled.select("label", F.posexplode(F.transform(vector_col, lambda x: x.cast("double"))).alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    means = parts.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "x")))["x"].alias("mean"))
    labels = {r.label: list(r.mean) for r in means.collect()}  # a vector for each label
    scored = F.array(*[F.struct((-V.cosine_similarity(F.col(vector_col), F.lit(v))).alias("d"), F.lit(name).alias("label")) for name, v in sorted(labels.items())])
    best = F.array_min(scored)
    return rows.select("id", best["label"].alias("label"), (-best["d"]).alias("score"))


def attempted(f: Callable[[str], str], kind: str = "string") -> Callable[[Column], Column]:
    """A function of single values as struct(data, error): a row that fails has its error and doesn't end the job."""

    @F.pandas_udf(f"data {kind}, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(x):
            try:
                return (None if x is None else f(x)), None
            except Exception as e:
                return None, f"{type(e).__name__}: {e}"

        for values in batches:
            yield pd.DataFrame([one(x) for x in values], columns=["data", "error"])

    return run


def zero_shot(vector: Column, labels: dict[str, list[float]]) -> Column:
    """Labels by the cosine similarity of their vectors to the row's, best first: array<struct<score, label>>."""
    scored = F.array(*[F.struct(V.cosine_similarity(vector, F.lit([float(x) for x in v])).alias("score"), F.lit(name).alias("label")) for name, v in sorted(labels.items())])
    return F.reverse(F.array_sort(scored))


def keyword_class(text: Column, keywords: dict[str, list[str]], default: str) -> Column:
    """The label whose keywords occur most often in the text; the first of equals, default without any."""
    words = tokens(text)
    among = lambda ks: lambda w: w.isin(ks)
    counts = F.array(*[F.struct(F.size(F.filter(words, among(ks))).alias("n"), F.lit(-i).alias("order"), F.lit(name).alias("label")) for i, (name, ks) in enumerate(keywords.items())])
    best = F.array_max(counts)
    return F.when(best["n"] > 0, best["label"]).otherwise(default)


#: Frequent words of some languages, a choice of our own.
FREQUENT = {
    "en": "the and of to in that is was for with it as on be at by".split(), "de": "der die und das den von zu mit ist nicht ein eine auch auf dem sich".split(),
    "fr": "le la les de des et un une dans est que pour qui pas sur au".split(), "es": "el la los las de que y en un una por con para es no se".split(),
}


def text_language(text: Column, default: str = "und") -> Column:
    return keyword_class(text, FREQUENT, default)


def rerank(hits: DataFrame, score: Column, k: int) -> DataFrame:
    """hits (query_id, id, ...) ordered anew by a score column and cut to k."""
    from heron.operators.search import ranked

    return ranked(hits.withColumn("score", score), k, "query_id")
