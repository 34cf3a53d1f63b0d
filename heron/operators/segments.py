"""A stored keyword index as a log of segments: appended, marked and merged under numbered versions, with the vectors of the same documents.

    path/log/<version>.json          what a version consists of; written last, so that a version is whole or not there
    path/forward/segment=<name>/     (id, dl, terms (term, tf), [vector]) of the segment's documents
    path/postings/segment=<name>/bucket=<b>/   a row for each term and window of documents, sorted by term and window
    path/dead/batch=<name>/          (segment, id, dl, terms) of removed documents

Nothing written is changed: adding writes a segment (and a batch of the documents that it replaces), removing writes a
batch, merging writes one segment in place of several. Files of versions no longer kept go with `vacuum`.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from heron.functions.text import tokens
from heron.operators import fusion
from heron.operators.keyword import BUCKETS, K1, PLACES, B, weight
from heron.operators.search import batch_top_k, ranked
from heron.operators.staging import BROADCAST_ROWS, remove, saved, small_side, spread

#: Documents of a window, at most; documents of a segment for each part of a bucket; postings that a task sorts at once, about.
WINDOW, PART, SORTED = 64, 1 << 20, 1 << 18
#: Segments of one size class that are merged; a class spans sizes up to so many times its least.
FAN = 8
#: Terms of a query set, or windows, up to which they are literals in the scan; more are joined.
LITERALS = 2000
#: Postings of a query set up to which they are all scored in one pass; more are read in rounds, by their bounds.
DIRECT = 20_000_000
#: Windows of a query that are scored first, at least (else k), to know k good documents; how far a bound may be off by rounding.
SEEDS, SLACK = 4, 1e-6


class Conflict(RuntimeError):
    """Another writer has made the version that this one was to become; read again and repeat the operation."""


def _pairs(names: tuple[str, str], left: pa.Array, right: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Lists of (left, right) structs, cut at the offsets."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([left, pa.array(right, pa.int32())], names=list(names)))


def _parts(batch: pa.RecordBatch, column: str, step: int = 1) -> Iterator[pa.RecordBatch]:
    """The batch in parts of about SORTED elements of a list column, each a multiple of `step` rows but for the last."""
    before, lo = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(batch[column]), 0).to_numpy())), 0
    while lo < batch.num_rows:
        many = int(np.searchsorted(before, before[lo] + SORTED, "right")) - 1 - lo
        yield batch.slice(lo, max(step, many // step * step))
        lo += max(step, many // step * step)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (id, dl, words, ...) with their sorted terms (term, tf) in place of the words."""
    for batch in (part for whole in batches for part in _parts(whole, "words")):
        words, n = batch["words"], batch.num_rows
        found = words.flatten().dictionary_encode()
        order = pc.sort_indices(found.dictionary)
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order))
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(words), 0).to_numpy())
        keys, tf = np.unique(row * max(1, len(order)) + rank[found.indices.to_numpy()], return_counts=True)
        terms = found.dictionary.take(order).take(pa.array(keys % max(1, len(order))))
        offsets = np.searchsorted(keys, np.arange(n + 1) * max(1, len(order)))
        columns = {**{c: batch[c] for c in batch.schema.names}, "words": _pairs(("term", "tf"), terms, tf, offsets)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=["terms" if c == "words" else c for c in columns])


def _postings(batches: Iterator[pa.RecordBatch], size: int, window: int) -> Iterator[pa.RecordBatch]:
    """Rows (term, window, id, tf, dl) of documents (id, dl, terms), those of a term and a window together: `size` documents of a batch that follow each other are a window, numbered from `window`."""
    for part in (part for whole in batches for part in _parts(whole, "terms", size)):
        terms, n = pc.list_flatten(part["terms"]), part.num_rows
        found = pc.struct_field(terms, "term").dictionary_encode()
        row = np.repeat(np.arange(n), pc.fill_null(pc.list_value_length(part["terms"]), 0).to_numpy())
        windows = -(-n // size)
        order = np.argsort(found.indices.to_numpy().astype(np.int64) * windows + row // size, kind="stable")
        at, of = pa.array(order), pa.array(row[order])
        columns = {"term": found.dictionary.take(found.indices.take(at)), "window": pa.array(row[order] // size + window)}
        columns |= {"id": part["id"].take(of), "tf": pc.struct_field(terms, "tf").take(at), "dl": part["dl"].take(of)}
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        window += windows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Posting rows of rows ([bucket,] term, window, id, tf, dl) that stand together by term and window: a run of one term and window is a row. A batch and the run that it may break are held."""

    def made(rows: pa.Table, starts: np.ndarray) -> pa.RecordBatch:
        tf, dl, ends = rows["tf"].to_numpy(), rows["dl"].to_numpy(), np.append(starts, rows.num_rows)
        run = np.repeat(np.arange(len(starts)), np.diff(ends))
        order = np.lexsort((dl, tf, run))  # the shortest document of each tf is the first
        new = np.append(True, (np.diff(run[order]) != 0) | (np.diff(tf[order]) != 0))
        best = order[new]
        postings = pa.StructArray.from_arrays([rows[c].combine_chunks() for c in ("id", "tf", "dl")], names=["id", "tf", "dl"])
        columns = {c: rows[c].combine_chunks().take(pa.array(starts)) for c in rows.column_names if c in ("bucket", "term", "window")}
        columns |= {"n": pa.array(np.diff(ends), pa.int32()), "top": _pairs(("tf", "dl"), pa.array(tf[best], pa.int32()), dl[best], np.searchsorted(run[best], np.arange(len(starts) + 1)))}
        columns["postings"] = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), postings)
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    held: pa.Table | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])]).combine_chunks()
        term, window = rows["term"].combine_chunks(), rows["window"].to_numpy()
        starts = np.append(0, np.flatnonzero((np.diff(window) != 0) | pc.not_equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False)) + 1)
        if len(starts) > 1:
            yield made(rows.slice(0, starts[-1]), starts[:-1])
        held = rows.slice(starts[-1])
    if held is not None:
        yield made(held, np.zeros(1, np.int64))


@dataclass(frozen=True)
class Version:
    """segments: name, docs, dl (sum of lengths), and dead: batch, docs, dl for each batch that has documents of it."""

    number: int
    segments: list[dict]
    operations: dict[str, int]

    def live(self) -> list[tuple[str, int, int]]:
        """Name, documents and length of each segment without its removed documents."""
        return [(s["name"], s["docs"] - sum(d["docs"] for d in s["dead"]), s["dl"] - sum(d["dl"] for d in s["dead"])) for s in self.segments]


class Store:
    """The index in a folder that driver and executors share. Ids are of one type; vectors are kept if with_vectors."""

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", with_vectors: bool = False, tokenize=tokens, buckets: int = BUCKETS, window: int = WINDOW):
        self.spark, self.path, self.tokenize, self.buckets, self.window = spark, path, tokenize, buckets, window
        terms = "terms array<struct<term: string, tf: int>>"
        self.schemas = {
            "forward": f"id {id_type}, dl int, {terms}" + (", vector array<float>" if with_vectors else "") + ", segment string",
            "postings": f"term string, window bigint, n int, top array<struct<tf: int, dl: int>>, postings array<struct<id: {id_type}, tf: int, dl: int>>, segment string, bucket int",
            "dead": f"of string, id {id_type}, dl int, {terms}, batch string",
        }
        self.columns = ["id", "dl", "terms", *(["vector"] if with_vectors else [])]

    # -- versions --

    def _files(self, path: str):
        folder = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return folder.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), folder

    def versions(self) -> list[int]:
        fs, folder = self._files(f"{self.path}/log")
        return sorted(int(x.getPath().getName()[:-5]) for x in fs.listStatus(folder) if x.getPath().getName().endswith(".json")) if fs.exists(folder) else []

    def version(self, number: int | None = None) -> Version:
        """The newest version, or a given one that is still kept; an empty one before the first write."""
        known = self.versions()
        if number is None and not known:
            return Version(0, [], {})
        fs, file = self._files(f"{self.path}/log/{known[-1] if number is None else number:012d}.json")
        stream = fs.open(file)
        try:
            text = bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()
        return Version(**json.loads(text))

    def _commit(self, base: Version, segments: list[dict], operation: str | None) -> int:
        """The next version, unless another writer has made it: the text is written aside and renamed."""
        number = base.number + 1
        done = base.operations | ({operation: number} if operation else {})
        fs, aside = self._files(f"{self.path}/log/{uuid.uuid4().hex}.tmp")
        out = fs.create(aside, False)
        out.write(json.dumps({"number": number, "segments": segments, "operations": done}).encode())
        out.close()
        _, file = self._files(f"{self.path}/log/{number:012d}.json")
        if fs.exists(file) or not fs.rename(aside, file):
            fs.delete(aside, False)
            raise Conflict(f"version {number} is there")
        return number

    # -- reading --

    def read(self, kind: str, names: list[str]) -> DataFrame:
        """Rows of the named segments or batches; their folders are listed, nothing else is."""
        key = "batch" if kind == "dead" else "segment"
        if not names:
            return self.spark.createDataFrame([], self.schemas[kind])
        return self.spark.read.schema(self.schemas[kind]).option("basePath", f"{self.path}/{kind}").parquet(*[f"{self.path}/{kind}/{key}={n}" for n in names])

    def _dead(self, segments: list[dict]) -> DataFrame:
        """(segment, id, dl, terms) of the removed documents of the segments."""
        batches = sorted({d["batch"] for s in segments for d in s["dead"]})
        return self.read("dead", batches).where(F.col("of").isin([s["name"] for s in segments])).select(F.col("of").alias("segment"), "id", "dl", "terms")

    def forward(self, segments: list[dict]) -> DataFrame:
        """The documents of the segments that are not removed, with their segment."""
        rows = self.read("forward", [s["name"] for s in segments])
        return rows.join(self._dead(segments).select("segment", "id"), ["segment", "id"], "left_anti") if any(s["dead"] for s in segments) else rows

    def snapshot(self, number: int | None = None) -> Snapshot:
        return Snapshot(self, self.version(number))

    # -- writing --

    def _segment(self, forward: DataFrame) -> list[dict]:
        """A segment of the documents, or none if there are none. The text is read and cut into terms once. Posting rows are made inside the tasks that read the stored terms, as a window is documents that stand together there, and only whole ones are shuffled, to their buckets."""
        name = uuid.uuid4().hex
        forward.select(*self.columns).write.parquet(f"{self.path}/forward/segment={name}")
        stored = self.read("forward", [name])
        n, total = stored.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
        if not n:
            return []
        size, parts = self.window, math.ceil(n / PART)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _blocks(_postings(batches, size, TaskContext.get().partitionId() << 32))  # a task's windows are its own

        blocks = stored.select("id", "dl", "terms").mapInArrow(run, self.schemas["postings"].replace(", segment string, bucket int", ""))
        dealt = blocks.withColumn("bucket", F.pmod(F.hash("term"), F.lit(self.buckets))).repartition("bucket", F.pmod(F.xxhash64("window"), F.lit(parts)))
        dealt.sortWithinPartitions("bucket", "term", "window").write.partitionBy("bucket").parquet(f"{self.path}/postings/segment={name}")
        return [{"name": name, "docs": n, "dl": total, "dead": []}]

    def _without(self, base: Version, ids: DataFrame) -> list[dict]:
        """The segments of base with the ids (id) marked as removed."""
        segments = [s | {"dead": list(s["dead"])} for s in base.segments]
        if not segments:
            return segments
        name = uuid.uuid4().hex
        gone = self.forward(segments).join(ids.distinct(), "id", "left_semi").select(F.col("segment").alias("of"), "id", "dl", "terms")
        gone.write.parquet(f"{self.path}/dead/batch={name}")
        counts = {r.of: r for r in self.read("dead", [name]).groupBy("of").agg(F.count("*").alias("docs"), F.sum("dl").alias("dl")).collect()}  # a row for each segment
        for s in segments:
            if r := counts.get(s["name"]):
                s["dead"].append({"batch": name, "docs": r.docs, "dl": r.dl})
        return [s for s in segments if s["docs"] > sum(d["docs"] for d in s["dead"])]

    def add(self, docs: DataFrame, operation: str | None = None, id_col: str = "id", text_col: str = "text", vector_col: str = "vector", merge: bool = True) -> int:
        """Add docs, which replace documents with their ids, and return the version; ids name documents, so give each once.

        An operation that is given a name is done once: repeated under the same name, after a failure or not, it
        returns the version that has it. A null text has no terms. Small segments are then merged.
        """
        base = self.version()
        if operation in base.operations:
            return base.operations[operation]
        kept = [F.col(vector_col).cast("array<float>").alias("vector")] if "vector" in self.columns else []
        words = spread(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *kept)).select("id", self.tokenize(F.col("text")).alias("words"), *[c for c in self.columns if c == "vector"])
        sized = words.select("id", F.size("words").alias("dl"), *words.columns[1:])
        new = self._segment(sized.mapInArrow(_counted, self.schemas["forward"].replace(", segment string", "")))
        number = self._commit(base, [*(self._without(base, self.read("forward", [new[0]["name"]]).select("id")) if new else base.segments), *new], operation)
        if merge:
            self.merge()
        return number

    def remove(self, ids: DataFrame, operation: str | None = None) -> int:
        """Remove the documents in ids (id); unknown ones are none. For `operation` see add."""
        base = self.version()
        if operation in base.operations:
            return base.operations[operation]
        return self._commit(base, self._without(base, ids.select("id")), operation)

    def clear(self, operation: str | None = None) -> int:
        base = self.version()
        return base.operations[operation] if operation in base.operations else self._commit(base, [], operation)

    def merge(self) -> int:
        """Merge FAN segments of one size class, as often as there are so many, and rewrite those of which half is removed; results stay the same."""
        while True:
            base = self.version()
            classes: dict[int, list[str]] = {}
            for name, docs, _ in base.live():
                classes.setdefault(int(math.log(max(1, docs), FAN)), []).append(name)
            sizes = {s["name"]: s["docs"] for s in base.segments}
            chosen = next((x[:FAN] for x in classes.values() if len(x) >= FAN), None) or [n for n, docs, _ in base.live() if 2 * docs < sizes[n]]
            if not chosen:
                return base.number
            old = [s for s in base.segments if s["name"] in chosen]
            self._commit(base, [s for s in base.segments if s["name"] not in chosen] + self._segment(self.forward(old)), None)

    def vacuum(self, keep: int = 1) -> None:
        """Remove versions but the newest `keep`, and all segments and batches that none of those has, such as those of failed writes. Not while others write or read older versions."""
        known = self.versions()
        kept = [self.version(n) for n in known[-keep:]]
        names = {"forward": {s["name"] for v in kept for s in v.segments}, "dead": {d["batch"] for v in kept for s in v.segments for d in s["dead"]}}
        names["postings"] = names["forward"]
        for n in known[:-keep]:
            remove(self.spark, f"{self.path}/log/{n:012d}.json")
        for kind, used in names.items():
            fs, folder = self._files(f"{self.path}/{kind}")
            for x in fs.listStatus(folder) if fs.exists(folder) else []:
                if x.getPath().getName().partition("=")[2] not in used:
                    remove(self.spark, x.getPath().toString())


class Snapshot:
    """One version of a store, for reading; later writes do not change it."""

    def __init__(self, store: Store, version: Version):
        self.store, self.at = store, version
        live = version.live()
        self.n_docs, self.total = sum(x[1] for x in live), sum(x[2] for x in live)
        self.avg_dl = self.total / self.n_docs if self.n_docs else 0.0
        self.changed = any(s["dead"] for s in version.segments)

    def documents(self) -> DataFrame:
        """(id, dl, terms[, vector]) of the documents."""
        return self.store.forward(self.at.segments).drop("segment")

    def postings(self) -> DataFrame:
        """(term, id, tf, dl) of the documents."""
        return self.documents().select("id", "dl", F.explode("terms").alias("t")).select("t.term", "id", "t.tf", "dl")

    def stats(self) -> DataFrame:
        """One row: n_docs, avg_dl, vocabulary."""
        sizes = F.lit(self.n_docs).cast("long").alias("n_docs"), F.lit(self.avg_dl).alias("avg_dl")
        return self.postings().agg(F.countDistinct("term").alias("vocabulary")).select(*sizes, "vocabulary")

    def vectors(self) -> DataFrame:
        """(id, vector) of the documents that have one."""
        return self.documents().where("vector IS NOT NULL").select("id", "vector")

    def blocks(self, terms: DataFrame, known: list[str] | None) -> DataFrame:
        """Posting rows of the terms (term). Where they are few, the scan gets them, and their buckets' folders, as literals."""
        rows = self.store.read("postings", [s["name"] for s in self.at.segments])
        if known is None:
            buckets = [r[0] for r in terms.select(F.pmod(F.hash("term"), F.lit(self.store.buckets))).distinct().collect()]  # as many as folders at most
            return rows.where(F.col("bucket").isin(buckets)).join(small_side(terms), "term", "left_semi")
        spark = self.store.spark
        buckets = [r[0] for r in spark.createDataFrame([(t,) for t in known], "term string").select(F.pmod(F.hash("term"), F.lit(self.store.buckets))).distinct().collect()] if known else []
        return rows.where(F.col("bucket").isin(buckets) & F.col("term").isin(known))

    def _plan(self, queries: DataFrame, k: int | None, k1: float, b: float, bounded: bool | None) -> dict[str, DataFrame]:
        """What a search reads, in one pass or in rounds: `blocks` are all posting rows of the queries' terms with their bounds; `first` the scores of each query's most promising windows; `rest` further scores; `read` the posting rows that were read."""
        asked = saved(queries.select("query_id", F.explode(self.store.tokenize(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times")))
        terms = asked.select("term").distinct()
        few = [r[0] for r in terms.limit(LITERALS + 1).collect()]
        found = self.blocks(terms, few if len(few) <= LITERALS else None)
        df = found.groupBy("term").agg(F.sum("n").alias("df"))
        if self.changed:
            gone = self.store._dead(self.at.segments).select(F.explode("terms").alias("t")).groupBy("t.term").agg(F.count("*").alias("gone"))
            df = df.join(gone, "term", "left").select("term", (F.col("df") - F.coalesce("gone", F.lit(0))).alias("df"))
        factors = saved(asked.join(df.where("df > 0"), "term"))
        n, postings = factors.agg(F.count("*"), F.coalesce(F.sum("df"), F.lit(0))).first()
        factors = F.broadcast(factors) if n <= BROADCAST_ROWS else factors
        part = lambda tf, dl: F.col("times") * weight(tf, dl, F.col("df"), F.lit(self.n_docs), F.lit(self.avg_dl), k1, b)
        total = lambda c: F.round(c, PLACES).alias("score")
        if k is None or bounded is False or bounded is None and postings <= DIRECT:
            rows = found.join(factors, "term").select("query_id", "segment", "times", "df", F.explode("postings").alias("p")).select("query_id", "segment", F.col("p.id").alias("id"), part(F.col("p.tf"), F.col("p.dl")).alias("part"))
            rows = rows.join(self.store._dead(self.at.segments).select("segment", "id"), ["segment", "id"], "left_anti") if self.changed else rows
            blocks = found.join(factors, "term").select("query_id", "segment", "window", "term")
            return {"blocks": blocks, "read": blocks, "first": rows.groupBy("query_id", "id").agg(total(F.sum("part"))).where("score > 0"), "rest": None}
        most = F.array_max(F.transform("top", lambda p: part(p["tf"], p["dl"])))
        blocks = saved(found.join(factors, "term").select("query_id", "segment", "window", "term", "times", "df", most.alias("most")))
        place = ["query_id", "segment", "window"]

        def scored(needed: DataFrame, *keys: str) -> DataFrame:
            """Sums of the needed posting rows for each document; where they are few, their terms and windows are literals in the scan."""
            rows = found
            if needed.count() <= 20 * LITERALS:
                names, numbers = needed.agg(F.collect_set("term"), F.collect_set("window")).first()
                rows = rows.where(F.col("term").isin(names)) if len(names) <= LITERALS else rows
                rows = rows.where(F.col("window").isin(numbers)) if len(numbers) <= LITERALS else rows
            rows = rows.join(small_side(needed), ["segment", "window", "term"]).select(*place, "times", "df", *[c for c in keys if c not in place], F.explode("postings").alias("p"))
            rows = rows.select(*place, *[c for c in keys if c not in place], F.col("p.id").alias("id"), part(F.col("p.tf"), F.col("p.dl")).alias("part"))
            if self.changed:
                rows = rows.join(self.store._dead(self.at.segments).select("segment", "id"), ["segment", "id"], "left_anti")
            return rows.groupBy(*place, *[c for c in keys if c not in place], "id").agg(F.sum("part").alias("part"))

        windows = blocks.groupBy(*place).agg(F.sum("most").alias("most")).withColumn("key", F.struct("segment", "window"))
        seeds = ranked(windows, max(SEEDS, k), "query_id", score="most", key="key").select(*place)
        marked = saved(blocks.join(seeds.withColumn("seed", F.lit(True)), place, "left"))
        read = marked.where("seed")
        first = saved(scored(read).select("query_id", "id", total(F.col("part"))).where("score > 0"))
        limits = ranked(first, k, "query_id").where(F.col("rank") == k).select("query_id", F.col("score").alias("bound"))
        # In a window, a document without the terms of greatest weight is no match if what the others can add is below the bound.
        down = Window.partitionBy(*place).orderBy(F.desc("most"), "term")
        rest = marked.where("seed IS NULL").drop("seed").join(limits, "query_id", "left").withColumn("bound", F.coalesce("bound", F.lit(0.0)) - SLACK)
        after = F.sum("most").over(Window.partitionBy(*place)) - F.sum("most").over(down.rowsBetween(Window.unboundedPreceding, -1))
        rest = rest.withColumn("needed", F.coalesce(after, F.sum("most").over(Window.partitionBy(*place))) >= F.col("bound"))
        rest = rest.withColumn("tail", F.sum(F.when(~F.col("needed"), F.col("most")).otherwise(0.0)).over(Window.partitionBy(*place)))
        rest = saved(rest)
        needed = rest.where("needed")
        if needed.isEmpty():
            return {"blocks": blocks, "read": read, "first": first, "rest": None}
        hopeful = saved(scored(needed, "tail", "bound").where("part + tail >= bound").select(*place, "id", "part"))
        tails = rest.where("NOT needed").join(small_side(saved(hopeful.select(*place).distinct())), place, "left_semi")
        more = scored(saved(tails)).select(*place, "id", F.col("part").alias("more"))
        found_rest = hopeful.join(more, [*place, "id"], "left").select("query_id", "id", total(F.col("part") + F.coalesce("more", F.lit(0.0)))).where("score > 0")
        read = read.select(*place, "term").unionByName(needed.select(*place, "term")).unionByName(tails.select(*place, "term"))
        return {"blocks": blocks, "read": read, "first": first, "rest": found_rest}

    def search(self, queries: DataFrame, k: int | None = 10, k1: float = K1, b: float = B, bounded: bool | None = None) -> DataFrame:
        """(query_id, rank, id, score) of the k best documents for each of queries (query_id, text); without k, all matches without rank.

        A term counts as often as the query has it. Up to DIRECT postings of the queries' terms are scored in one pass;
        more (or bounded=True) in rounds: documents are dealt into windows; a posting row holds a term's documents of
        one window and the greatest weight that they can have, for any average length. After the most
        promising windows have given k documents, the k-th score bounds the others: of a window, only the terms of
        greatest weight are read without which that score can't be reached, and the other terms only where a document
        may still reach it. Results are exact. Scores have PLACES decimals; ties go to the smaller id.
        """
        if not self.at.segments:
            kind = self.store.schemas["forward"].split(",")[0]
            return self.store.spark.createDataFrame([], f"query_id {queries.schema['query_id'].dataType.simpleString()}, " + ("rank int, " if k else "") + f"{kind}, score double")
        plan = self._plan(queries, k, k1, b, bounded)
        found = plan["first"] if plan["rest"] is None else plan["first"].unionByName(plan["rest"])
        return found if k is None else ranked(found, k, "query_id").select("query_id", "rank", "id", "score")

    def blocks_read(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, blocks, blocks_read): posting rows of a query's terms, and how many of them a search for k documents reads beyond their bounds."""
        plan = self._plan(queries, k, K1, B, True)
        read = plan["read"].groupBy("query_id").agg(F.count("*").alias("blocks_read"))
        return plan["blocks"].groupBy("query_id").agg(F.count("*").alias("blocks")).join(read, "query_id")

    def hybrid(self, queries: DataFrame, k: int = 10, how: str = "weighted", metric: str = "cosine", **options) -> DataFrame:
        """Fused hits for queries (query_id, text, vector): both legs read this version, so they agree on the documents there are."""
        vector = batch_top_k(self.vectors(), queries.select("query_id", "vector"), 3 * k, metric)
        return fusion.hybrid(vector, self.search(queries.select("query_id", "text"), 3 * k), k, how, **options)
