"""Ingestion: documents to chunks to vectors to a table, as a batch or as a stream of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from heron.functions.chunking import Chunker, chunked, chunker, recursive_chunks, semantic_chunks
from heron.functions.models import embed, rerank
from heron.operators import search

Step = Callable[[DataFrame], DataFrame]


def pipeline(*steps: Step | tuple[str, Step]) -> Step:
    """Steps one after the other, named or not; Spark plans them as one. An error in building a step's plan names the step and its place."""

    def run(df: DataFrame) -> DataFrame:
        for i, step in enumerate(steps):
            name, f = step if isinstance(step, tuple) else (getattr(step, "__name__", "step"), step)
            try:
                df = f(df)
            except Exception as e:
                raise RuntimeError(f"step {i} ({name}): {e}") from e
        return df

    return run


# ---- steps: each returns a function of a table ----------------------------------------------------------------------


def chunk_step(strategy: str = "recursive", id_col: str = "id", text_col: str = "text", **options) -> Step:
    return lambda df: chunked(df, chunker(strategy, **options), id_col, text_col)


def embed_step(embedder: Callable[[Column], Column] | None = None, text_col: str = "text", vector_col: str = "vector") -> Step:
    return lambda df: df.withColumn(vector_col, (embedder or embed())(F.col(text_col)))


def semantic_chunk_step(by: str, at: str, text: str, vector: str, **options) -> Step:
    return lambda df: semantic_chunks(df, by, at, text, vector, **options)


def search_step(rows: DataFrame, k: int = 10, **options) -> Step:
    """Queries (query_id, vector) to their hits in rows."""
    return lambda df: search.batch_top_k(rows, df, k, **options)


def rerank_step(score: Column, k: int) -> Step:
    return lambda df: rerank(df, score, k)


def map_step(name: str, f: Callable[[Column], Column], column: str = "text") -> Step:
    """A column made of another by a model or an expression: classify, summarize, generate."""
    return lambda df: df.withColumn(name, f(F.col(column)))


def store_step(path: str, mode: str = "append") -> Step:
    """The table written as Parquet, and read again."""

    def store(df: DataFrame) -> DataFrame:
        df.write.mode(mode).parquet(path)
        return df.sparkSession.read.parquet(path)

    return store


def ingest_chunks(chunks: DataFrame, embedder: Callable[[Column], Column] | None = None) -> DataFrame:
    """Given chunks (id, at, text, ...) with their vectors and chunk_id."""
    return chunks.select(F.concat_ws("_", F.lit("chunk"), F.col("id").cast("string"), F.col("at").cast("string")).alias("chunk_id"), *chunks.columns, (embedder or embed())(F.col("text")).alias("vector"))


def reindexed(rows: DataFrame, model: str, embedder: Callable[[Column], Column], text_col: str = "text", vector_col: str = "vector", model_col: str = "model") -> DataFrame:
    """rows with the vectors of another model made anew and marked with this one; rows of this model stay as they are and are not embedded."""
    mine = F.col(model_col).eqNullSafe(F.lit(model))
    anew = rows.where(~mine).withColumns({vector_col: embedder(F.col(text_col)), model_col: F.lit(model)})
    return rows.where(mine).unionByName(anew.select(*rows.columns))


def ingested(docs: DataFrame, split: Chunker | Callable[[Column], Column] | None = None, embedder: Callable[[Column], Column] | None = None, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """(chunk_id, id, at, text, kind, path, vector): a row for each chunk. Without an embedder the vectors are hashed word counts."""
    chunks = chunked(docs, split or recursive_chunks(), id_col, text_col)
    return chunks.withColumn("vector", (embedder or embed())(F.col("text")))


def ingest_stream(docs: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """A stream of documents appended to Parquet; each micro-batch has a folder of its own that a rerun writes anew, so nothing is stored twice."""

    def store(batch: DataFrame, number: int) -> None:
        ingested(batch, **options).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stale(rows: DataFrame, model: str, model_col: str = "model", after: str | None = None, id_col: str = "id") -> DataFrame:
    """Rows that another model embedded, in id order from behind `after`, for re-embedding that can be resumed."""
    out = rows.where(~F.col(model_col).eqNullSafe(F.lit(model)))
    return (out if after is None else out.where(F.col(id_col) > after)).orderBy(id_col)
