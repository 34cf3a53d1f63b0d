"""Queries on stored tables: caches, chains, limits, loaders, imports, migrations, encryption, steps and models."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.functions import filters, jsontext, models, privacy
from heron.functions import text as X
from heron.functions import vectors as V
from heron.operators import cache, capacity, logs, metrics, quantize, search
from heron.operators.staging import shared_dir, spread
from heron.plans.tables import table
from heron.sources import collections, formats, loaders, records
from heron.streaming import ingest, limits

KEY = privacy.derived_key("password", b"salt-of-the-table", 1000)


def _vectors(spark, d) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")


def _fresh(spark) -> str:
    return f"{shared_dir(spark)}/query-{uuid.uuid4().hex}"


# ---- semantic cache -------------------------------------------------------------------------------------------------


def _cache(spark, d) -> tuple[DataFrame, DataFrame]:
    """Every third vector is a cached prompt, every third one a prompt to look up; labels are the models."""
    rows = _vectors(spark, d)
    model = (F.col("label") % 2).alias("model_id")
    entries = rows.where("id % 3 = 0").select(F.col("id").alias("entry_id"), (F.col("id") % 50).alias("key"), model, "vector", (F.col("id") * 1000).alias("created_ms"), (F.col("id") * 1000 + F.col("id") * 7919 % 997).alias("accessed_ms"))
    prompts = rows.where("id % 3 = 1").select(F.col("id").alias("prompt_id"), (F.col("id") % 75).alias("key"), model, "vector", F.lit(600_000).cast("long").alias("asked_ms"))
    return entries, prompts


def cache_lookup(spark, d):
    found = cache.lookup(*_cache(spark, d), threshold=0.3, ttl_ms=400_000)
    return found.withColumn("score", F.round("score", 6))


def cache_stats(spark, d):
    entries, prompts = _cache(spark, d)
    return cache.stats(entries, cache.lookup(entries, prompts, threshold=0.3, ttl_ms=400_000)).withColumn("hit_rate", F.round("hit_rate", 6))


def cache_eviction(spark, d):
    """What goes of a cache that holds 100 entries at most."""
    return cache.evicted(_cache(spark, d)[0], 100).select("entry_id")


def cache_expiry(spark, d):
    return cache.unexpired(_cache(spark, d)[0], 600_000, 400_000).select("entry_id")


# ---- chains and limits ----------------------------------------------------------------------------------------------


def _chain(spark, d) -> DataFrame:
    rows = table(spark, d, "events").withColumn("body", F.concat_ws("|", F.col("event_id").cast("string"), "event_type", "props"))
    return logs.chained(rows.select("user_id", "event_id", "body"), "user_id", "event_id", "body")


def chain_heads(spark, d):
    """The last hash of each user's chain, which covers all entries before it."""
    return _chain(spark, d).groupBy("user_id").agg(F.count("*").alias("n"), F.max_by("hash", "event_id").alias("head"))


def chain_links(spark, d):
    """Chains in which an entry was put in later: its link doesn't fit."""
    rows = _chain(spark, d)
    forged = rows.where("event_id % 701 = 700").select("user_id", (F.col("event_id") * 2 + 1).alias("seq"), "body", F.lit("0").alias("previous_hash"), logs.chain_hash(F.lit("0"), F.col("body")).alias("hash"))
    both = rows.select("user_id", (F.col("event_id") * 2).alias("seq"), "body", "previous_hash", "hash").unionByName(forged)
    v = logs.chain_verdict(both, "seq", "previous_hash", "hash", logs.chain_hash(F.col("previous_hash"), F.col("body")), "user_id")
    return v.withColumnRenamed("key", "user_id")


def _requests(spark, d) -> DataFrame:
    return table(spark, d, "events").select("user_id", "event_id", logs.millis(F.col("ts")).alias("at"))


def buckets(spark, d):
    """Token buckets of users: 3 tokens at most, one more each hour."""
    return logs.token_bucket(_requests(spark, d), "user_id", "at", "event_id", 3, 1, 3_600_000).select("event_id", "allowed", "tokens")


def buckets_stream(spark, d):
    """The same by the keyed state over a stream of the table's folder, read to its end."""
    events = spark.readStream.schema(table(spark, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    requests = events.select("user_id", "event_id", logs.millis(F.col("ts")).alias("at"))
    out = _fresh(spark)
    q = limits.token_bucket(requests, "user_id", "at", "event_id", 3, 1, 3_600_000).writeStream.format("parquet").option("checkpointLocation", f"{out}-log").option("path", out).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema("by long, key long, at long, allowed boolean, tokens double").parquet(out).select(F.col("key").alias("event_id"), "allowed", "tokens")


def admitted(spark, d):
    """At most three requests of a user in any hour; refused ones don't count."""
    return logs.admitted(_requests(spark, d), "user_id", "at", "event_id", 3, 3_600_000).select("event_id", "allowed")


def replayed(spark, d):
    """Events as a log of transactions of ten entries: an error rolls its transaction back, others are committed; the last write of each user counts."""
    e, i = table(spark, d, "events").where("user_id IS NOT NULL"), F.col("event_id")
    entries = e.select(F.floor(i / 10).alias("txn"), (i * 2).alias("seq"), "user_id", F.when(F.col("event_type") == "error", "rollback").when(F.col("event_type") == "signup", "delete").otherwise("put").alias("kind"), "value")
    ends = table(spark, d, "events").where("event_id % 10 = 9").select(F.floor(i / 10).alias("txn"), (i * 2 + 1).alias("seq"), F.lit(None).cast("long").alias("user_id"), F.lit("commit").alias("kind"), F.lit(None).cast("double").alias("value"))
    return logs.replayed(entries.unionByName(ends), "txn", "seq", "user_id", "kind").select("user_id", "seq", "value")


# ---- loaders and formats --------------------------------------------------------------------------------------------


def load_csv(spark, d):
    """Documents written as CSV and loaded with two text columns."""
    path = _fresh(spark)
    table(spark, d, "documents").select("doc_id", "lang", "text").write.csv(path, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    docs = loaders.load(spark, path, "csv", text_columns=["lang", "text"], joined_by=": ", id_column="doc_id")
    return docs.select(F.col("id").cast("long").alias("id"), F.md5("text").alias("text_md5"), F.element_at("metadata", "lang").alias("lang"))


def load_json(spark, d):
    """Events as JSON files with records at a path, loaded with their metadata."""
    path = _fresh(spark)
    rows = table(spark, d, "events").select(F.struct(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("title"), F.struct(F.col("user_id").alias("user")).alias("by")).alias("r"), F.floor(F.col("event_id") / 1000).alias("file"))
    files = rows.groupBy("file").agg(F.to_json(F.struct(F.struct(F.collect_list("r").alias("items")).alias("data"))).alias("value"))
    files.repartition("file").write.partitionBy("file").text(path)
    docs = loaders.load(spark, f"{path}/file=*", "json", records="data.items", text_fields=["title", "by.user"])
    return docs.select(F.col("id").cast("long").alias("id"), "text", F.element_at("metadata", "title").alias("title"))


def load_text(spark, d):
    """Conversations as text files, a file for each, split at a separator."""
    path = _fresh(spark)
    turns = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("turn", F.regexp_replace("text", "---", "").alias("t"))))["t"], "\n---\n").alias("value"))
    loaders.write_texts(turns, path, "conv_id", "value")
    parts = loaders.load(spark, path, "text", separator="---")
    conv = F.nullif(F.regexp_extract("source", r"/text-(-?\d+)\.txt$", 1), F.lit("")).cast("long")
    return parts.select(conv.alias("conv_id"), F.element_at("metadata", "totalParts").cast("long").alias("parts")).groupBy("conv_id").agg(F.max("parts").alias("parts"), F.count("*").alias("n"))


def load_source(spark, d):
    """Documents as files of JSON lines, read in byte ranges by the data source."""
    path = _fresh(spark)
    table(spark, d, "documents").select(F.to_json(F.struct(F.col("doc_id").alias("id"), "text", "lang", "n_chars")).alias("value")).write.text(path)
    spark.dataSource.register(records.Documents)
    docs = spark.read.format("heron_documents").option("rangeBytes", 1 << 20).load(path)
    return docs.select(F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), F.element_at("metadata", "lang").alias("lang"), F.element_at("metadata", "n_chars").cast("long").alias("n_chars"))


def stream_source(spark, d):
    """Documents as a table that grows by two commits, streamed into a second one that is written twice under one name."""
    first, second = _fresh(spark), _fresh(spark)
    spark.dataSource.register(records.Documents)
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("id"), "text", F.col("source"), F.create_map(F.lit("lang"), F.coalesce("lang", F.lit(""))).alias("metadata"))
    docs.where("doc_id % 2 = 0").write.format("heron_documents").mode("append").save(first)

    def copied():
        stream = spark.readStream.format("heron_documents").load(first)
        stream.writeStream.format("heron_documents").option("path", second).option("writeName", "copy").option("checkpointLocation", f"{second}-state").trigger(availableNow=True).start().awaitTermination()

    copied()
    docs.where("doc_id % 2 = 1 OR doc_id IS NULL").write.format("heron_documents").mode("append").save(first)
    copied()
    rows = spark.read.format("heron_documents").load(second)
    return rows.select(F.col("id").cast("long").alias("doc_id"), F.md5("text").alias("text_md5"), "source", F.element_at("metadata", "lang").alias("lang"))


def converted(spark, d):
    """Vectors as JSON lines, converted to nested and from there to CSV, and read again."""
    rows = _vectors(spark, d).select(F.col("id").cast("string").alias("id"), F.transform("vector", lambda x: x.cast("double")).alias("vector"), F.concat(F.lit("text "), F.col("id")).alias("text"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    base = _fresh(spark)
    formats.to_jsonl(rows).write.text(f"{base}/a")
    formats.convert(spark, f"{base}/a", f"{base}/b", "nested")
    formats.convert(spark, f"{base}/b/batch=*", f"{base}/c", "csv", form="nested")
    back = formats.read_vectors(spark, f"{base}/c")
    return back.select(F.col("id").cast("long").alias("id"), "text", F.try_element_at("metadata", F.lit("label")).cast("long").alias("label"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


def _imported(spark, d) -> tuple[DataFrame, DataFrame]:
    """Records of which some have no vector, a vector of another width, or neither vector nor text."""
    rows, i = _vectors(spark, d), F.col("id")
    vector = F.when(i % 5 == 0, F.lit(None).cast("array<float>")).when(i % 5 == 1, F.slice("vector", 1, 8)).otherwise(F.col("vector"))
    text = F.when(i % 10 == 5, F.lit(None).cast("string")).otherwise(F.concat(F.lit("text "), i))
    records = rows.select(F.when(i % 97 == 96, F.lit(None).cast("long")).otherwise(i).alias("id"), vector.alias("vector"), text.alias("text"))
    held = rows.where("id % 4 = 0").select(F.lit("a").alias("collection_id"), "id", "vector", F.lit("old").alias("text"))
    return collections.import_from(held, "a", records, 64, models.embed(lambda texts: models.hashing_embedding(texts, 64)))


def import_report(spark, d):
    return _imported(spark, d)[1]


def import_table(spark, d):
    return _imported(spark, d)[0].select("id", "text", F.size("vector").cast("long").alias("dimensions"))


def exported(spark, d):
    """A table exported as JSON lines, changed, and merged with its export again."""
    held = _vectors(spark, d).select((F.col("label") % 3).cast("string").alias("collection_id"), "id", "vector")
    path = _fresh(spark)
    collections.export(held, path, ["0", "1"])
    changed = collections.cleared(held, "0").withColumn("vector", F.transform("vector", lambda x: F.lit(0.0).cast("float")))
    return collections.imported(changed, path).select("collection_id", "id", F.round(V.norm(F.col("vector")), 5).alias("norm"))


# ---- tables ---------------------------------------------------------------------------------------------------------


def _held(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(F.col("lang").alias("collection_id"), F.col("doc_id").alias("id"), F.col("source").alias("note"), "n_chars")


def migrated(spark, d):
    """Three versions of a table: a new column, a changed and a dropped one, rows that go."""
    steps = [
        (3, lambda t: t.where("n_chars_k > 0")),
        (1, lambda t: collections.transformed(t, n_chars_k=F.floor(F.col("n_chars") / 100), n_chars=None)),
        (2, lambda t: collections.transformed(t, note=F.upper("note"))),
        (4, lambda t: t.limit(0)),
    ]
    out, version = collections.migrated(_held(spark, d), 0, steps, target=3)
    return out.withColumn("version", F.lit(version).cast("long"))


def copied(spark, d):
    """One collection copied to another in part, then a third renamed."""
    t = collections.copied(_held(spark, d).drop("n_chars"), "en", "de", F.col("id") % 2 == 0)
    return collections.renamed(t, "fr", "xx").groupBy("collection_id").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def encrypted(spark, d):
    """Text and vectors of a table encrypted and read again; the filter column stays readable."""
    rows = _vectors(spark, d).withColumn("note", F.concat(F.lit("note "), F.col("id")))
    secret = collections.encrypted(rows, KEY, ["note", "vector"])
    back = collections.decrypted(secret.where("label = 3"), KEY, {"note": "string", "vector": "array<float>"})
    return back.select("id", "note", F.round(V.norm(F.col("vector")), 5).alias("norm"))


def redacted(spark, d):
    """Documents written through a hook that redacts their metadata."""
    rows = spread(table(spark, d, "documents").select(F.lit("a").alias("collection_id"), F.col("doc_id").alias("id"), F.create_map(F.lit("text"), F.col("text")).alias("metadata")))
    out = collections.hooked(rows.limit(0), collections.upserted, rows, before=(lambda t: t,), after=(lambda t: t.withColumn("metadata", X.redact_metadata(F.col("metadata"))),))
    return out.select("id", F.md5(F.element_at("metadata", "text")).alias("redacted_md5"))


def lists(spark, d):
    """Filters on lists and objects of JSON metadata."""
    meta = F.concat(F.lit('{"tags": ["a", '), F.to_json(F.struct(F.col("event_type").alias("t"))).substr(F.lit(6), F.length("event_type") + 2), F.lit('], "at": {"x": 1}}'))
    rows = table(spark, d, "events").withColumn("meta", F.parse_json(meta))
    return filters.apply_filter(rows, {"tags": ["a", "click"], "at": {"x": 1}}, "meta").select("event_id")


def fitting(spark, d):
    """Which texts are JSON of a schema: a third has a string for a number, a third is cut off."""
    i = F.col("event_id")
    text = F.when(i % 3 == 0, F.col("props")).when(i % 3 == 1, F.lit('{"k": "seven"}')).otherwise(F.expr("left(props, length(props) - 1)"))
    return table(spark, d, "events").select("event_id", jsontext.fits(text, "k int").alias("fits"))


def validated(spark, d):
    """Why documents are invalid: no id, a wrong width, a value that is not finite, a long text."""
    i = F.col("id")
    rows = _vectors(spark, d).select(F.when(i % 7 == 0, F.lit(" ")).otherwise(i.cast("string")).alias("id"), i.alias("at"), F.when(i % 5 == 0, F.slice("vector", 1, 3)).when(i % 5 == 1, F.transform("vector", lambda x: F.lit(float("nan")).cast("float"))).otherwise(F.col("vector")).alias("vector"), F.repeat(F.lit("x"), (i % 4 * 100).cast("int")).alias("text"))
    return rows.select("at", F.array_join(filters.valid_document("id", "vector", text_col="text", dimensions=64, most_text=250), "; ").alias("reasons"))


def text_fields(spark, d):
    """The text of metadata under one of the usual names."""
    i = F.col("event_id")
    name = F.when(i % 3 == 0, "text").when(i % 3 == 1, "body").otherwise("other")
    rows = table(spark, d, "events").select("event_id", F.parse_json(F.concat(F.lit('{"n": 1, "'), name, F.lit('": "'), F.col("event_type"), F.lit('"}'))).alias("m"))
    return rows.select("event_id", filters.text_field("m").alias("text"))


# ---- vectors --------------------------------------------------------------------------------------------------------


def with_vectors(spark, d):
    rows = _vectors(spark, d)
    first = rows.where("id = 0").select("vector").first()  # the query vector: one row
    best = search.top_k(rows, list(first.vector) if first else [], 10, include_vectors=True)
    return best.select("id", F.round("score", 6).alias("score"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


def indexed(spark, d):
    """An inverted file written, read and probed in all of its lists, which is exact."""
    rows, path = _vectors(spark, d), _fresh(spark)
    search.write_index(rows, search.fit_centroids(rows, 8), path)
    lists, centroids = search.read_index(spark, path)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.probe(lists, centroids, queries, 10, probes=8).withColumn("score", F.round("score", 6))


def merged_calibration(spark, d):
    """Calibrations of two halves, merged."""
    rows = _vectors(spark, d)
    c = quantize.merge_calibrations(quantize.calibrate(rows.where("id % 2 = 0")), quantize.calibrate(rows.where("id % 2 = 1")))
    return c.select(F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x")).select(F.col("dim").cast("long").alias("dim"), F.round("x.low", 6).alias("low"), F.round("x.high", 6).alias("high"))


def recalibrated(spark, d):
    """Codes made with the calibration of half of the vectors, coded anew by what they stand for: the new bounds."""
    rows = _vectors(spark, d)
    scale = quantize.calibrate(rows.where("id % 2 = 0"))
    coded = rows.join(F.broadcast(scale), F.lit(True)).select("id", quantize.scalar_codes(F.col("vector"), F.col("low"), F.col("high")).alias("codes"))
    new = quantize.recalibrated(coded, scale)[1]
    return new.select(F.posexplode(F.arrays_zip("low", "high")).alias("dim", "x")).select(F.col("dim").cast("long").alias("dim"), F.round("x.low", 6).alias("low"), F.round("x.high", 6).alias("high"))


def delta_sq8(spark, d):
    """Deltas in 8 bits by label, decoded again: the mean and the greatest error."""
    rows = _vectors(spark, d)
    back = quantize.delta_vectors(*quantize.delta_codes(rows, "label", "id"), "label", "id").withColumnRenamed("vector", "back")
    e = V.euclidean(F.col("vector"), F.col("back"))
    return rows.join(back, ["label", "id"]).agg(F.count("*").alias("n"), F.round(F.avg(e), 5).alias("mean_error"), F.round(F.max(e), 5).alias("max_error"))


def scaled_sensitivity(spark, d):
    """Vectors that aren't of unit length: 1.1 times their greatest distance."""
    rows = _vectors(spark, d).select(F.transform("vector", lambda x: x.cast("double") * (F.col("label") + 1)).alias("vector"))
    return privacy.sensitivity(rows).select(F.round("sensitivity", 6).alias("sensitivity"))


def laplace_noise(spark, d):
    """Laplace noise on every vector: its mean, and its mean size against the scale."""
    rows, scale = _vectors(spark, d), privacy.laplace_scale(2.0, 2.0)
    n = rows.select(F.explode(F.zip_with(privacy.noisy_vector(F.col("vector"), F.col("id"), scale=scale), "vector", lambda a, b: a - b)).alias("e"))
    return n.agg(F.count("*").alias("n"), F.round(F.abs(F.avg("e")), 1).alias("bias"), F.round(F.avg(F.abs("e")) / scale, 1).alias("size"))


def classified(spark, d):
    """Vectors by the nearest mean vector of the labels of those with even ids."""
    rows = _vectors(spark, d)
    return models.nearest_class(rows, rows.where("id % 2 = 0")).withColumn("score", F.round("score", 6)).select("id", F.col("label").cast("long").alias("label"), "score")


def compatible(spark, d):
    held = table(spark, d, "embeddings").groupBy(F.col("label").alias("collection_id")).agg(F.count("*").alias("n"), F.first(F.size("embedding")).alias("dimensions"))
    held = held.withColumns({"model_id": F.when(F.col("collection_id") == 0, F.lit(None).cast("string")).when(F.col("collection_id") < 4, "new").otherwise("old"), "provider": F.lit("own"), "dimensions": F.when(F.col("collection_id") == 2, 32).otherwise(F.col("dimensions"))})
    return models.compatibility(held, "new", "own", 64).select("collection_id", "status")


def recommended(spark, d):
    """Parts as models: the five best for one task on a device of 20 GB storage and 3 GB memory."""
    i = F.col("p_partkey")
    of = lambda names: F.element_at(F.array(*[F.lit(x) for x in names]), (i % len(names) + 1).cast("int"))
    rows = table(spark, d, "part").select(i.alias("model_id"), F.when(i % 2 == 0, "embedding").otherwise("generation").alias("task"), (F.col("p_size") * 500.0).alias("size_mb"), (i % 40 * 100.0).alias("memory_mb"), of(["gpu", "wasm", "cpu"]).alias("device"), of(["high", "medium", "low", "other", "medium"]).alias("quality"), of(["slow", "fast", "medium", "slow", "fast", "slow", "medium"]).alias("speed"))
    return capacity.recommended(rows, "embedding", 20_000.0, 3000.0, gpu=True).select("model_id", "score")


# ---- texts ----------------------------------------------------------------------------------------------------------


def masks(spark, d):
    """Every different find of personal data, masked."""
    docs = spread(table(spark, d, "documents").select("doc_id", "text"))
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), F.regexp_extract_all("text", F.lit(f"({p})"), F.lit(1)).alias("found")) for k, p in X.PII.items() if k != "date"])
    found = docs.select(F.explode(kinds).alias("x")).select("x.kind", F.explode("x.found").alias("match")).distinct()
    masked = F.coalesce(*[F.when(F.col("kind") == k, X.mask(k, F.col("match"))) for k in X.PII])
    return found.select("kind", "match", masked.alias("masked"))


def language_names(spark, d):
    return table(spark, d, "documents").groupBy(X.language_name(F.col("lang")).alias("language")).agg(F.count("*").alias("n"))


def thresholds(spark, d):
    names = sorted(models.THRESHOLDS)
    known = F.element_at(F.array(*[F.lit(x) for x in [*names, "unknown"]]), (F.col("vec_id") % (len(names) + 1) + 1).cast("int"))
    return table(spark, d, "embeddings").select("vec_id", models.default_threshold(known).alias("threshold"))


def quota_ages(spark, d):
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "M", "h", "D", "w", "y")]), (F.col("event_id") % 6 + 1).cast("int"))
    return table(spark, d, "events").select("event_id", X.parse_quota_age(F.concat((F.col("event_id") % 90).cast("string"), unit)).alias("ms"))


def contents(spark, d):
    """Messages as parts and as plain texts, read as text."""
    quoted = F.to_json(F.struct(F.col("text").alias("t"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("t")))) - 6)
    parts = F.concat(F.lit('[{"type":"text","text":'), quoted, F.lit('},{"type":"image","data":"x"},{"type":"text","text":"and more"}]'))
    message = F.when(F.col("turn") % 2 == 0, parts).otherwise(F.col("text"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.content_text(message)).alias("text_md5"), F.size(X.content_parts(message)).cast("long").alias("parts"))


def bleu_4(spark, d):
    """Texts without every seventh word against the whole text and the next one."""
    b = table(spark, d, "benchmark")
    kept = F.array_join(F.filter(X.words(F.col("a.text")), lambda w, i: i % 7 != 6), " ")
    pairs = b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("pair_id"), kept.alias("candidate"), F.array("a.text", "b.text").alias("references"))
    return metrics.bleu(pairs).withColumn("bleu", F.round("bleu", 6))


def labels(spark, d):
    rows = table(spark, d, "events").select("event_type", F.when(F.col("value") > 50, "large").alias("size"))
    return metrics.distinct_labels(rows, "event_type", "size")


def evaluated(spark, d):
    rows = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id").select(F.col("quality").alias("label"), "text")
    return metrics.evaluate(rows, F.when(F.length("text") >= 1000, 1).otherwise(0)).withColumn("accuracy", F.round("accuracy", 6))


def windows_estimate(spark, d):
    """What an ingestion of fixed windows would store."""
    from heron.functions import chunking

    docs = spread(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"))
    chunks = docs.select(F.explode(chunking.windows(F.col("text"))).alias("c")).select("c.text")
    return metrics.ingestion_estimate(docs, chunks)


def stepped(spark, d):
    """A pipeline of named steps: queries are embedded vectors, searched, ranked anew and marked."""
    rows = _vectors(spark, d)
    asked = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    run = ingest.pipeline(("search", ingest.search_step(rows, 10)), ("rerank", ingest.rerank_step(-F.col("id").cast("double"), 3)), ("mark", ingest.map_step("even", lambda c: c % 2 == 0, "id")))
    return run(asked).select("query_id", "rank", "id", "even")


QUERIES = {
    "cache_lookup": cache_lookup, "cache_stats": cache_stats, "cache_eviction": cache_eviction, "cache_expiry": cache_expiry, "chain_heads": chain_heads, "chain_links": chain_links, "token_bucket": buckets, "token_bucket_stream": buckets_stream, "rate_limit_admitted": admitted, "log_replay": replayed,
    "load_csv": load_csv, "load_json": load_json, "load_text": load_text, "load_source": load_source, "stream_source": stream_source, "convert_formats": converted, "import_report": import_report, "import_table": import_table, "table_export": exported, "table_migrate": migrated, "table_copy": copied,
    "table_encrypt": encrypted, "table_redact": redacted, "filter_lists": lists, "json_fits": fitting, "validate": validated, "text_field": text_fields, "vec_include": with_vectors, "vec_index_file": indexed, "sq8_merge": merged_calibration,
    "sq8_recalibrate": recalibrated, "delta_sq8": delta_sq8, "dp_sensitivity_scaled": scaled_sensitivity, "dp_laplace": laplace_noise, "classify_vectors": classified, "model_check": compatible, "recommend_models": recommended, "pii_masks": masks,
    "language_names": language_names, "default_thresholds": thresholds, "quota_ages": quota_ages, "message_text": contents, "bleu_4": bleu_4, "distinct_labels": labels, "evaluate": evaluated, "ingest_estimate": windows_estimate, "pipeline_steps": stepped,
}

_E = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, label FROM embeddings)"
_U = f"{_E}, u AS (SELECT id, label, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS dim FROM e)"
_NORM = "sqrt(list_inner_product(v, v))"
_CODE = "CASE WHEN high = low THEN 128 ELSE greatest(0, least(255, floor((x - low) / (high - low) * 255 + 0.5))) END"
_CACHE = f"""WITH {_E}, n AS (SELECT id AS entry_id, id % 50 AS key, label % 2 AS model_id, v, id * 1000 AS created_ms FROM e WHERE id % 3 = 0), p AS (SELECT id AS prompt_id, id % 75 AS key, label % 2 AS model_id, v FROM e WHERE id % 3 = 1),
    x AS (SELECT key, model_id, arg_max(entry_id, created_ms) AS xe, max(created_ms) AS created FROM n GROUP BY ALL), a AS (SELECT p.*, xe, created FROM p LEFT JOIN x USING (key, model_id)),
    s AS (SELECT prompt_id, entry_id, created_ms, list_cosine_similarity(a.v, n.v) AS score, row_number() OVER (PARTITION BY prompt_id ORDER BY list_cosine_similarity(a.v, n.v) DESC, entry_id) AS r FROM a JOIN n ON a.model_id = n.model_id WHERE xe IS NULL),
    f AS (SELECT prompt_id, CASE WHEN 600000 - created <= 400000 THEN xe END AS entry_id, 1.0::DOUBLE AS score, 'exact' AS kind FROM a WHERE xe IS NOT NULL
        UNION ALL SELECT a.prompt_id, CASE WHEN s.score >= 0.3 AND 600000 - created_ms <= 400000 THEN entry_id END, s.score, 'similar' FROM a LEFT JOIN s ON s.prompt_id = a.prompt_id AND r = 1 WHERE xe IS NULL)"""
_BUCKETS = """WITH RECURSIVE o AS MATERIALIZED (SELECT coalesce(user_id, -1) AS u, event_id, (epoch_us(ts) // 1000) AS t, row_number() OVER (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_id) AS r FROM events),
    s(u, event_id, r, since, tokens, allowed) AS (SELECT u, event_id, r, t, 2.0::DOUBLE, true FROM o WHERE r = 1
        UNION ALL SELECT o.u, o.event_id, o.r, CASE WHEN (t - since) // 3600000 > 0 THEN t ELSE since END, least(3, tokens + (t - since) // 3600000) - CASE WHEN least(3, tokens + (t - since) // 3600000) >= 1 THEN 1 ELSE 0 END, least(3, tokens + (t - since) // 3600000) >= 1
        FROM s JOIN o ON o.u = s.u AND o.r = s.r + 1) SELECT event_id, allowed, tokens FROM s"""
_KEPT = "vec_id % 97 != 96 AND vec_id % 10 != 5"
_MASKS = {"email": "CASE WHEN instr(m, '@') > 3 THEN left(m, 1) || repeat('*', instr(m, '@') - 3) || substr(m, instr(m, '@') - 1) ELSE repeat('*', length(m)) END", "ssn": "'***-**-' || right(m, 4)", "ipAddress": "left(m, 1) || repeat('*', length(m) - 2) || right(m, 1)"}
_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w != '')"


def _redacted() -> str:
    out = "text"
    for k in X.DEFAULT_PII:
        out = f"regexp_replace({out}, '{X.PII[k]}', '{X.REPLACEMENTS[k]}', 'g')"
    return out


def _bleu() -> str:
    grams = lambda n, w: f"list_transform(range(1, len({w}) - {n - 2}), lambda i: array_to_string({w}[i:i + {n - 1}], ' '))"
    parts = [f"b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), k AS (SELECT a.item_id AS pair_id, list_filter(a.w, lambda x, i: (i - 1) % 7 != 6) AS c, a.w AS w0, z.w AS w1 FROM b a JOIN b z ON z.item_id = a.item_id + 1)"]
    for n in range(1, 5):
        told = " UNION ALL ".join(f"SELECT pair_id, {i} AS ref, unnest({grams(n, f'w{i}')}) AS g FROM k" for i in (0, 1))
        parts.append(f"c{n} AS (SELECT pair_id, g, count(*) AS n FROM (SELECT pair_id, unnest({grams(n, 'c')}) AS g FROM k) GROUP BY ALL), r{n} AS (SELECT pair_id, g, max(n) AS n FROM (SELECT pair_id, ref, g, count(*) AS n FROM ({told}) GROUP BY ALL) GROUP BY ALL)")
        parts.append(f"p{n} AS (SELECT pair_id, sum(least(c{n}.n, coalesce(r{n}.n, 0))) / sum(c{n}.n) AS p{n} FROM c{n} LEFT JOIN r{n} USING (pair_id, g) GROUP BY pair_id)")
    near = "CASE WHEN abs(len(w1) - len(c)) < abs(len(w0) - len(c)) THEN len(w1) ELSE len(w0) END"
    least, mean = "least(coalesce(p1, 0), coalesce(p2, 0), coalesce(p3, 0), coalesce(p4, 0))", "exp((ln(p1) + ln(p2) + ln(p3) + ln(p4)) / 4)"
    joins = " ".join(f"LEFT JOIN p{n} USING (pair_id)" for n in range(1, 5))
    return f"WITH {', '.join(parts)} SELECT pair_id, round(CASE WHEN len(c) = 0 OR {least} = 0 THEN 0 ELSE CASE WHEN len(c) >= {near} THEN 1 ELSE exp(1 - {near} / len(c)) END * {mean} END, 6)::DOUBLE AS bleu FROM k {joins}"


_PRICED = """SELECT p_partkey AS model_id, p_size * 500.0::DOUBLE AS size_mb, p_partkey % 40 * 100.0::DOUBLE AS memory_mb, ['gpu', 'wasm', 'cpu'][p_partkey % 3 + 1] AS device, [100, 60, 30, 50, 60][p_partkey % 5 + 1] AS quality, [30, 100, 60, 30, 100, 30, 60][p_partkey % 7 + 1] AS speed FROM part WHERE p_partkey % 2 = 0"""

SQL = {
    "cache_lookup": f"{_CACHE} SELECT prompt_id, entry_id, CASE WHEN entry_id IS NOT NULL THEN round(score, 6) END AS score, CASE WHEN entry_id IS NOT NULL THEN kind END AS kind FROM f",
    "cache_stats": f"{_CACHE} SELECT (SELECT count(*) FROM n) AS entries, count(entry_id) AS hits, count(*) - count(entry_id) AS misses, round(count(entry_id) / count(*), 6) AS hit_rate, (SELECT min(created_ms) FROM n) AS oldest_ms, (SELECT max(created_ms) FROM n) AS newest_ms FROM f",
    "cache_eviction": "SELECT entry_id FROM (SELECT vec_id AS entry_id, row_number() OVER (ORDER BY vec_id * 1000 + vec_id * 7919 % 997, vec_id) AS k, count(*) OVER () AS n FROM embeddings WHERE vec_id % 3 = 0) WHERE k <= n - 100",
    "cache_expiry": "SELECT vec_id AS entry_id FROM embeddings WHERE vec_id % 3 = 0 AND 600000 - vec_id * 1000 <= 400000",
    "chain_heads": "SELECT user_id, count(*) AS n, list_reduce(list_prepend('', list(body ORDER BY event_id)), lambda a, x: sha256(a || x)) AS head FROM (SELECT user_id, event_id, concat_ws('|', event_id::VARCHAR, event_type, props) AS body FROM events) GROUP BY user_id",
    "chain_links": "SELECT user_id, count(*) + count(*) FILTER (event_id % 701 = 700) AS checked, min(event_id * 2 + 1) FILTER (event_id % 701 = 700) AS broken_at, CASE WHEN count(*) FILTER (event_id % 701 = 700) > 0 THEN 'previous hash' END AS reason FROM events GROUP BY user_id",
    "token_bucket": _BUCKETS, "token_bucket_stream": _BUCKETS,
    "log_replay": """WITH e AS (SELECT *, event_id // 10 AS txn FROM events), g AS (SELECT txn FROM e GROUP BY txn HAVING count(*) FILTER (event_type = 'error' AND user_id IS NOT NULL) = 0 AND count(*) FILTER (event_id % 10 = 9) > 0)
        SELECT user_id, seq, value FROM (SELECT user_id, event_id * 2 AS seq, value, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS k FROM e JOIN g USING (txn) WHERE user_id IS NOT NULL) WHERE k = 1 AND event_type != 'signup'""",
    "load_csv": "SELECT doc_id AS id, md5(lang || CASE WHEN trim(text, ' ') = '' THEN '' ELSE ': ' || trim(text, ' ') END) AS text_md5, lang FROM documents",
    "load_json": "SELECT event_id AS id, event_type || coalesce(' ' || user_id, '') AS text, event_type AS title FROM events",
    "load_source": "SELECT doc_id, md5(text) AS text_md5, lang, n_chars FROM documents",
    "stream_source": "SELECT doc_id, md5(text) AS text_md5, source, coalesce(lang, '') AS lang FROM documents",
    "load_text": "SELECT conv_id, count(*) AS parts, count(*) AS n FROM conversations WHERE regexp_replace(text, '\\s+', '', 'g') != '' GROUP BY conv_id",
    "convert_formats": f"WITH {_E} SELECT id, 'text ' || id AS text, label::BIGINT AS label, round({_NORM}, 6) AS norm FROM e",
    "import_report": f"SELECT count(*) FILTER (vec_id % 97 != 96 AND vec_id % 5 > 1) AS imported, count(*) FILTER (NOT ({_KEPT})) AS skipped, count(*) FILTER ({_KEPT} AND vec_id % 5 <= 1) AS re_embedded FROM embeddings",
    "import_table": f"SELECT vec_id AS id, CASE WHEN {_KEPT} THEN 'text ' || vec_id ELSE 'old' END AS text, 64::BIGINT AS dimensions FROM embeddings WHERE {_KEPT} OR vec_id % 4 = 0",
    "table_export": f"WITH {_E} SELECT (label % 3)::VARCHAR AS collection_id, id, CASE WHEN label % 3 = 2 THEN 0 ELSE round({_NORM}, 5) END AS norm FROM e",
    "table_migrate": "SELECT lang AS collection_id, doc_id AS id, upper(source) AS note, n_chars // 100 AS n_chars_k, 3::BIGINT AS version FROM documents WHERE n_chars // 100 > 0",
    "table_copy": "SELECT collection_id, count(*) AS n, CAST(sum(id) AS BIGINT) AS ids FROM (SELECT CASE WHEN lang = 'fr' THEN 'xx' ELSE lang END AS collection_id, doc_id AS id FROM documents UNION ALL SELECT 'de', doc_id FROM documents WHERE lang = 'en' AND doc_id % 2 = 0) GROUP BY collection_id",
    "table_encrypt": f"WITH {_E} SELECT id, 'note ' || id AS note, round({_NORM}, 5) AS norm FROM e WHERE label = 3",
    "table_redact": f"SELECT doc_id AS id, md5({_redacted()}) AS redacted_md5 FROM documents",
    "filter_lists": "SELECT event_id FROM events WHERE event_type = 'click'",
    "json_fits": "SELECT event_id, event_id % 3 = 0 AS fits FROM events",
    "validate": "SELECT vec_id AS at, array_to_string(list_filter([CASE WHEN vec_id % 7 = 0 THEN 'id is empty' END, CASE WHEN vec_id % 5 = 1 THEN 'vector is not finite' END, CASE WHEN vec_id % 5 = 0 THEN 'dimensions differ' END, CASE WHEN vec_id % 4 = 3 THEN 'text is too large' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM embeddings",
    "text_field": "SELECT event_id, CASE WHEN event_id % 3 < 2 THEN event_type END AS text FROM events",
    "vec_include": f"WITH {_E} SELECT e.id, round(list_cosine_similarity(e.v, q.v), 6) AS score, round(sqrt(list_inner_product(e.v, e.v)), 6) AS norm FROM e, (SELECT v FROM e WHERE id = 0) q ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.id LIMIT 10",
    "vec_index_file": f"WITH {_E} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT q.id AS query_id, e.id, list_cosine_similarity(e.v, q.v) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.id) AS rank FROM e, e q WHERE q.id % 20 = 0) WHERE rank <= 10",
    "sq8_merge": f"WITH {_U} SELECT dim, round(min(x), 6) AS low, round(max(x), 6) AS high FROM u GROUP BY dim",
    "sq8_recalibrate": f"WITH {_U}, c AS (SELECT dim, min(x) AS low, max(x) AS high FROM u WHERE id % 2 = 0 GROUP BY dim) SELECT dim, round(min({_CODE} / 255.0::DOUBLE * (high - low) + low), 6) AS low, round(max({_CODE} / 255.0::DOUBLE * (high - low) + low), 6) AS high FROM u JOIN c USING (dim) GROUP BY dim",
    "delta_sq8": f"""WITH {_U}, g AS (SELECT label, id, dim, x AS whole, x - lag(x) OVER (PARTITION BY label, dim ORDER BY id) AS x FROM u), c AS (SELECT dim, min(x) AS low, max(x) AS high FROM g GROUP BY dim),
        k AS (SELECT label, id, dim, whole, CASE WHEN x IS NULL THEN whole ELSE {_CODE} / 255.0::DOUBLE * (high - low) + low END AS d FROM g JOIN c USING (dim)),
        r AS (SELECT id, whole - sum(d) OVER (PARTITION BY label, dim ORDER BY id ROWS UNBOUNDED PRECEDING) AS off FROM k), t AS (SELECT id, sqrt(sum(off * off)) AS err FROM r GROUP BY id) SELECT count(*) AS n, round(avg(err), 5) AS mean_error, round(max(err), 5) AS max_error FROM t""",
    "dp_sensitivity_scaled": f"WITH {_E}, s AS (SELECT id, list_transform(v, lambda x: x * (label + 1)) AS v FROM e) SELECT round(max(list_distance(a.v, b.v)) * 1.1::DOUBLE, 6) AS sensitivity FROM s a, s b",
    "dp_laplace": "SELECT CAST(sum(len(embedding)) AS BIGINT) AS n, 0.0::DOUBLE AS bias, 1.0::DOUBLE AS size FROM embeddings",
    "classify_vectors": f"WITH {_U}, m AS (SELECT label, list(x ORDER BY dim) AS v FROM (SELECT label, dim, avg(x) AS x FROM u WHERE id % 2 = 0 GROUP BY ALL) GROUP BY label) SELECT id, label::BIGINT AS label, round(score, 6) AS score FROM (SELECT e.id, m.label, list_cosine_similarity(e.v, m.v) AS score, row_number() OVER (PARTITION BY e.id ORDER BY list_cosine_similarity(e.v, m.v) DESC, m.label) AS k FROM e, m) WHERE k = 1",
    "model_check": "SELECT label AS collection_id, CASE WHEN label = 0 THEN 'compatible' WHEN label = 2 THEN 'dimension-mismatch' WHEN label < 4 THEN 'compatible' ELSE 'incompatible' END AS status FROM embeddings GROUP BY label",
    "recommend_models": f"""WITH m AS ({_PRICED}), s AS (SELECT model_id, CASE WHEN size_mb / 20000 <= 0.1 THEN 40 WHEN size_mb / 20000 <= 0.3 THEN 30 WHEN size_mb / 20000 <= 0.6 THEN 20 ELSE 10 END + CASE WHEN memory_mb / 3000 <= 0.25 THEN 30 WHEN memory_mb / 3000 <= 0.5 THEN 20 ELSE 10 END
        + CASE device WHEN 'gpu' THEN 30 WHEN 'wasm' THEN 25 ELSE 20 END AS fit, quality, speed FROM m WHERE size_mb <= 20000 AND memory_mb <= 3000) SELECT model_id, CAST(floor(0.5::DOUBLE * least(100, fit) + 0.3::DOUBLE * quality + 0.2::DOUBLE * speed + 0.5) AS BIGINT) AS score FROM s ORDER BY score DESC, model_id LIMIT 5""",
    "pii_masks": " UNION ALL ".join(f"SELECT '{k}' AS kind, m AS match, CASE WHEN length(m) <= 4 THEN repeat('*', length(m)) ELSE {_MASKS.get(k, chr(39).join(('repeat(', '*', ', length(m) - 4) || right(m, 4)')))} END AS masked FROM (SELECT DISTINCT unnest(regexp_extract_all(text, '{p}')) AS m FROM documents)" for k, p in X.PII.items() if k != "date"),
    "language_names": "SELECT CASE lang WHEN 'en' THEN 'English' WHEN 'de' THEN 'German' WHEN 'fr' THEN 'French' WHEN 'es' THEN 'Spanish' ELSE lang END AS language, count(*) AS n FROM documents GROUP BY 1",
    "default_thresholds": f"SELECT vec_id, ([{', '.join(f'{models.THRESHOLDS[x]}::DOUBLE' for x in sorted(models.THRESHOLDS))}, NULL])[vec_id % {len(models.THRESHOLDS) + 1} + 1] AS threshold FROM embeddings",
    "quota_ages": "SELECT event_id, event_id % 90 * [1000, 60000, 3600000, 86400000, 604800000, NULL][event_id % 6 + 1] AS ms FROM events",
    "message_text": "SELECT conv_id, turn, md5(CASE WHEN turn % 2 = 0 THEN text || ' and more' ELSE text END) AS text_md5, CASE WHEN turn % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS parts FROM conversations",
    "bleu_4": _bleu(),
    "distinct_labels": "SELECT DISTINCT label FROM (SELECT event_type AS label FROM events UNION ALL SELECT 'large' FROM events WHERE value > 50) WHERE label IS NOT NULL",
    "evaluate": "SELECT round(avg(CASE WHEN quality = CASE WHEN length(text) >= 1000 THEN 1 ELSE 0 END THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy FROM documents JOIN labels USING (doc_id)",
    "ingest_estimate": "WITH w AS (SELECT trim(substr(text, s + 1, 500), ' ') AS t FROM documents, unnest(range(0, CAST(length(text) AS BIGINT), 450)) u(s)) SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS chunks, CAST(sum(length(t)) AS BIGINT) AS chars, CAST(floor(sum(length(t)) / count(*) + 0.5) AS BIGINT) AS avg_chunk FROM w WHERE length(t) > 0",
    "pipeline_steps": f"WITH {_E}, r AS (SELECT query_id, id FROM (SELECT q.id AS query_id, e.id, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.id) AS rank FROM e, e q WHERE q.id % 20 = 0) WHERE rank <= 10) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, id % 2 = 0 AS even FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM r) WHERE rank <= 3",
}
