"""Queries on `documents`, `pages`, `benchmark` and `labels`: keyword and hybrid search, metrics, text functions, chunks, formats."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heron.functions import chunking, jsontext, models, privacy
from heron.functions import text as X
from heron.functions import vectors as V
from heron.operators import duplicates, fusion, metrics, search, segments
from heron.operators.staging import exists, shared_dir, small_side, spread
from heron.plans.tables import table
from heron.sources import formats, html
from heron.streaming import ingest

_INDEXES: dict[tuple, str] = {}


def _docs(spark, d) -> DataFrame:
    return table(spark, d, "documents").withColumnRenamed("doc_id", "id")


def _text(spark, d) -> DataFrame:
    """id and text of the documents, dealt to all cores."""
    return spread(_docs(spark, d).select("id", "text"))


def _store(spark, d) -> segments.Store:
    """The keyword index of the documents, written once in an application for each state of the table's files."""
    files = table(spark, d, "documents").select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time").distinct()
    state = files.agg(F.count("*"), F.sum(F.xxhash64("*").cast("decimal(20,0)"))).first()
    key = (spark.sparkContext.applicationId, d, *state)
    if key not in _INDEXES or not exists(spark, f"{_INDEXES[key]}/log"):
        path = f"{shared_dir(spark)}/keyword-{uuid.uuid4().hex}"
        segments.Store(spark, path).add(_docs(spark, d), "documents")
        _INDEXES[key] = path
    return segments.Store(spark, _INDEXES[key])


def _index(spark, d) -> segments.Snapshot:
    """The version with all documents of the index."""
    return _store(spark, d).snapshot(1)


def _asked(spark, d) -> DataFrame:
    """The benchmark's texts whose ids are divisible by 20, as queries."""
    return table(spark, d, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")


def bm25(spark, d):
    return _index(spark, d).search(_asked(spark, d), 10).withColumn("score", F.round("score", 6))


def bm25_stats(spark, d):
    return _index(spark, d).stats().withColumn("avg_dl", F.round("avg_dl", 6))


def maintained(spark, d):
    """The index after every third document was removed and every sixth one came back with another text, as was each one after them: its postings by term."""
    postings = _changed(spark, d).postings()
    return postings.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def _changed(spark, d) -> segments.Snapshot:
    """A store of its own: all documents but each third one in four writes, then the changes, each under a name and each done twice."""
    docs, store = _docs(spark, d).select("id", "text"), segments.Store(spark, f"{shared_dir(spark)}/keyword-{uuid.uuid4().hex}")
    for k in range(4):
        store.add(docs.where((F.col("id") % 4 == k) & ((F.col("id") % 3 != 0) | (F.col("id") % 4 < 2))), f"part {k}")
    for _ in range(2):
        store.remove(docs.where("id % 3 = 0").select("id"), "every third")
        store.add(docs.where("id % 6 = 0 OR id % 6 = 1").withColumn("text", F.concat("text", F.lit(" newword"))), "every sixth")
    return store.snapshot()


def maintained_search(spark, d):
    """Hits in the changed index, by the bounds of posting rows."""
    return _changed(spark, d).search(_asked(spark, d), 10, bounded=True).withColumn("score", F.round("score", 6))


def bounded_search(spark, d):
    """Hits of the whole index by the bounds of posting rows: the rows of bm25_search."""
    return _index(spark, d).search(_asked(spark, d), 10, bounded=True).withColumn("score", F.round("score", 6))


def hybrid_maintained(spark, d):
    """Fused hits of a store with texts and vectors: documents whose id an embedding has, after every fifth was removed and every tenth came back with its vector turned round."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    docs = _docs(spark, d).select("id", "text").join(vectors, "id")
    store = segments.Store(spark, f"{shared_dir(spark)}/hybrid-{uuid.uuid4().hex}", with_vectors=True)
    store.add(docs, "all")
    store.remove(docs.where("id % 5 = 0").select("id"), "every fifth")
    store.add(docs.where("id % 10 = 0").withColumn("vector", F.transform("vector", lambda x: -x)), "every tenth")
    asked = _asked(spark, d).join(vectors.withColumnRenamed("id", "query_id"), "query_id")
    return store.snapshot().hybrid(asked, 10, "rrf").withColumn("score", F.round("score", 9))


def postings(spark, d):
    p = _index(spark, d).postings()
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


def stems(spark, d):
    """Stemmed tokens without stop words, counted."""
    words = _text(spark, d).select(F.explode(X.tokens(F.col("text"), stemming=True, stop_words=X.STOP_WORDS)).alias("stem"))
    return words.groupBy("stem").agg(F.count("*").alias("n"))


def _legs(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    return search.batch_top_k(rows, queries, 30), _index(spark, d).search(_asked(spark, d), 30)


def hybrid_weighted(spark, d):
    out = fusion.hybrid(*_legs(spark, d), k=10)
    return out.select("query_id", "rank", "id", *[F.round(c, 6).alias(c) for c in ("score", "vector_score", "keyword_score")])


def hybrid_rrf(spark, d):
    return fusion.hybrid(*_legs(spark, d), k=10, how="rrf").withColumn("score", F.round("score", 9))


def search_documents(spark, d):
    """Hits joined to their documents."""
    hits = small_side(_index(spark, d).search(_asked(spark, d), 10))
    return hits.join(_docs(spark, d).select("id", "lang", "source"), "id").select("query_id", "rank", "id", "lang", "source")


def reranked(spark, d):
    hits = small_side(_index(spark, d).search(_asked(spark, d), 10)).join(_docs(spark, d).select("id", "n_chars"), "id")
    return models.rerank(hits, -F.col("n_chars").cast("double"), 5).select("query_id", "rank", "id", "score")


def prompt_cache(spark, d):
    """User turns, and copies of them with other white space, that an earlier turn with the same normal form answers."""
    asked = table(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", "text")
    copies = asked.select((F.col("conv_id") + 1_000_000).alias("conv_id"), "turn", F.concat(F.lit("  "), F.regexp_replace("text", " ", " \n ")).alias("text"))
    turns = asked.unionByName(copies).select("conv_id", "turn", F.md5(X.normalize_prompt(F.col("text"))).alias("key"))
    first = turns.groupBy("key").agg(F.min(F.struct("conv_id", "turn")).alias("f"), F.count("*").alias("n"))
    return turns.join(first.where("n > 1"), "key").where("conv_id != f.conv_id OR turn != f.turn").select("conv_id", "turn", F.col("f.conv_id").alias("hit_conv"), F.col("f.turn").alias("hit_turn"))


def pii_counts(spark, d):
    kinds = list(X.PII)
    return _text(spark, d).agg(*[F.sum(X.count_pii(F.col("text"), k)).alias(k) for k in kinds], F.count(F.when(X.has_pii(F.col("text")), 1)).alias("documents"))


def pii_redact(spark, d):
    return _text(spark, d).select("id", F.md5(X.redact(F.col("text"))).alias("redacted_md5"))


def pii_mask(spark, d):
    found = _docs(spark, d).select("id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({X.PII['email']})"), F.lit(1)))).alias("match"))
    return found.select("id", "match", X.mask("email", F.col("match")).alias("masked"))


def pii_find(spark, d):
    return _text(spark, d).select("id", F.explode(X.find_pii("text")).alias("m")).select("id", F.col("m.kind").alias("kind"), F.col("m.start").alias("start"), F.col("m.value").alias("value"))


def dup_exact(spark, d):
    return duplicates.exact_groups(_docs(spark, d))


def filtered_text(spark, d):
    rule = F.when(F.length("text") >= 1000, 1).otherwise(0)
    return _docs(spark, d).join(table(spark, d, "labels").withColumnRenamed("doc_id", "id"), "id").select("id", F.col("quality").alias("label"), rule.alias("prediction"))


def clf_confusion(spark, d):
    return metrics.confusion(filtered_text(spark, d))


def clf_accuracy(spark, d):
    return metrics.accuracy(filtered_text(spark, d)).withColumn("accuracy", F.round("accuracy", 6))


def clf_scores(spark, d):
    s = metrics.class_scores(filtered_text(spark, d))
    return s.select(F.col("class").cast("long").alias("class"), "tp", "fp", "fn", "tn", "support", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


def clf_averages(spark, d):
    a = metrics.averages(filtered_text(spark, d))
    return a.select(*[F.round(c, 6).alias(c) for c in a.columns])


def _pairs(spark, d) -> DataFrame:
    """Each benchmark text beside the next one."""
    b = table(spark, d, "benchmark")
    return b.alias("a").join(b.alias("b"), F.col("b.item_id") == F.col("a.item_id") + 1).select(F.col("a.item_id").alias("pair_id"), F.col("a.text").alias("candidate"), F.col("b.text").alias("reference"))


def rouge_1(spark, d):
    return metrics.rouge_n(_pairs(spark, d), 1).withColumn("rouge", F.round("rouge", 6))


def rouge_2(spark, d):
    return metrics.rouge_n(_pairs(spark, d), 2).withColumn("rouge", F.round("rouge", 6))


def rouge_l(spark, d):
    return metrics.rouge_l(_pairs(spark, d)).withColumn("rouge", F.round("rouge", 6))


def bleu(spark, d):
    return metrics.bleu(_pairs(spark, d), 1).withColumn("bleu", F.round("bleu", 6))


def html_text(spark, d):
    return spread(table(spark, d, "pages").select("page_id", "html")).select("page_id", F.md5(html.html_text(F.col("html"))).alias("text_md5"), html.html_title(F.col("html")).alias("title"))


def html_meta(spark, d):
    """Meta elements of the pages, to whose heads two are added."""
    i = F.col("page_id")
    added = F.concat(F.lit("<meta name='author' content='a"), i % 3, F.lit("'><META property=\"og:kind\" content=\"k"), i % 2, F.lit('">'))
    pages = table(spark, d, "pages").select("page_id", F.concat(F.substring_index("html", "</head>", 1), added, F.lit("</head>"), F.col("html")).alias("html"))
    m = pages.select("page_id", F.explode(html.html_meta(F.col("html"))).alias("name", "content"))
    return m.groupBy("name", "content").agg(F.count("*").alias("n"))


def html_slug(spark, d):
    return table(spark, d, "pages").select("page_id", html.slug(html.html_title(F.col("html"))).alias("slug"))


def chunk_windows(spark, d):
    c = _text(spark, d).select("id", F.explode(chunking.windows(F.col("text"))).alias("c"))
    return c.groupBy("id").agg(F.count("*").alias("n"), F.sum(F.length("c.text")).alias("chars"), F.max("c.start").cast("long").alias("last"))


def chunk_estimate(spark, d):
    return _docs(spark, d).select("id", metrics.estimate_chunks(F.length("text")).cast("long").alias("chunks"))


def chunk_recursive(spark, d):
    return chunking.chunked(_text(spark, d), chunking.chunker("recursive")).select("chunk_id", "id", "at", "start", "end", "text")


def chunk_markdown(spark, d):
    return chunking.chunked(_text(spark, d), chunking.chunker("markdown")).select("chunk_id", "id", "at", "start", "end", "kind", "text")


def chunk_code(spark, d):
    pages = table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("text"))
    return chunking.chunked(pages, chunking.code_chunks("javascript")).select("chunk_id", "id", "at", "kind", F.length("text").alias("chars"))


def chunk_stats(spark, d):
    c = chunking.chunked(_text(spark, d), chunking.recursive_chunks())
    return metrics.chunk_stats(c)


def clause_lists(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.posexplode(chunking.clause_list("text")).alias("at", "clause"))


#: A line of source code for some of the pages, by page_id % 8, as pages themselves hold little code.
_CODE = ("", "using System;\nclass Program { }", "import Foundation\nlet x = 1", "package demo\nfun main() { }", "#include <vector>\nint main() { }", "def __init__(self):\n  pass", "require 'json'\nputs 1\nend", "const f = (x) => x")


def code_languages(spark, d):
    """Languages of the pages, which a line of source code precedes."""
    line = F.element_at(F.array(*[F.lit(c) for c in _CODE]), (F.col("page_id") % len(_CODE)).cast("int") + 1)
    return table(spark, d, "pages").select("page_id", chunking.code_language(F.concat(line, F.lit("\n"), F.col("html"))).alias("language"))


def text_language(spark, d):
    found = spread(_docs(spark, d)).select(F.col("lang"), models.text_language(F.col("text")).alias("found"))
    return found.groupBy("lang", "found").agg(F.count("*").alias("n"))


def ingest_documents(spark, d):
    """Chunks and their vectors, stored by no one: what ingestion writes."""
    return ingest.ingested(_text(spark, d)).select("chunk_id", "id", "at", F.size("vector").alias("dimensions"), F.round(V.norm(F.col("vector")), 3).alias("norm"))


def zero_shot(spark, d):
    labels = {str(r.label): list(r.vector) for r in table(spark, d, "embeddings").where("vec_id < 4").select(F.col("vec_id").alias("label"), F.col("embedding").alias("vector")).collect()}  # four label vectors
    rows = table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    best = models.zero_shot(F.col("vector"), labels)[0]
    return rows.select("vec_id", best["label"].alias("label"), F.round(best["score"], 6).alias("score"))


def prompts(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(X.normalize_prompt(F.col("text"))).alias("key"))


def ages(spark, d):
    """Ages made of the numbers of events, read back, and sizes and durations formatted."""
    unit = F.element_at(F.array(*[F.lit(u) for u in ("s", "m", "h", "d", "M", "y")]), (F.col("event_id") % 6 + 1).cast("int"))
    text = F.concat((F.col("event_id") % 90).cast("string"), unit)
    size = F.col("event_id") * F.col("event_id") * 37
    return table(spark, d, "events").select("event_id", F.round(X.parse_age(text)).cast("long").alias("ms"), X.format_bytes(size).alias("bytes"), X.format_duration(size).alias("duration"))


def encrypted(spark, d):
    """AES-GCM there and back: rows that came back unchanged."""
    key = privacy.derived_key("password", b"salt-of-the-table", 1000)
    rows = _docs(spark, d).select("id", "text", privacy.encrypt(F.col("text"), key).alias("secret"))
    return rows.agg(F.count("*").alias("n"), F.count(F.when(privacy.decrypt(F.col("secret"), key) == F.col("text"), 1)).alias("same"), F.count(F.when(F.col("secret").contains(F.left("text", F.lit(20))), 1)).alias("leaks"))


def randomized(spark, d):
    """Randomised labels: how many are kept, to a tenth."""
    rows = table(spark, d, "labels").select("doc_id", F.col("quality").cast("string").alias("label"))
    out = privacy.randomized_response(F.col("label"), ["0", "1"], F.col("doc_id"), 2.0)
    return rows.agg(F.count("*").alias("n"), F.round(F.avg((out == F.col("label")).cast("double")), 1).alias("kept"))


def content_hash(spark, d):
    return _docs(spark, d).select("id", F.sha2("text", 256).alias("sha256"), F.base64(F.unhex(F.sha2("text", 256))).alias("digest"))


def _records(spark, d) -> DataFrame:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.transform("embedding", lambda x: x.cast("double")).alias("vector"), F.concat(F.lit("text "), F.col("vec_id")).alias("text"), F.create_map(F.lit("label"), F.col("label").cast("string")).alias("metadata"))
    return rows


def _back(records: DataFrame) -> DataFrame:
    return records.select(F.col("id").cast("long").alias("id"), "text", F.try_element_at("metadata", F.lit("label")).cast("long").alias("label"), F.round(V.norm(F.col("vector")), 6).alias("norm"))


def roundtrip_jsonl(spark, d):
    return _back(formats.parse_jsonl(formats.to_jsonl(_records(spark, d))))


def roundtrip_nested(spark, d):
    return _back(formats.parse_nested(formats.to_nested(_records(spark, d), F.pmod(F.xxhash64("id"), F.lit(64)))))


def roundtrip_parallel(spark, d):
    return _back(formats.parse_parallel(formats.to_parallel(_records(spark, d), F.pmod(F.xxhash64("id"), F.lit(64)))))


def roundtrip_csv(spark, d):
    return _back(formats.parse_csv_vectors(formats.to_csv(_records(spark, d), ["label"])))


def import_counts(spark, d):
    return formats.import_counts(_records(spark, d))


def json_props(spark, d):
    """A field of the JSON in events by a dotted path, through VARIANT."""
    rows = table(spark, d, "events").select("event_id", F.parse_json("props").alias("record"))
    return rows.select("event_id", formats.value_at("record", "k", "bigint").alias("k"))


def json_found(spark, d):
    """JSON found in text around it, and repaired after it breaks off."""
    rows = table(spark, d, "events").select("event_id", "props")
    wrapped = F.concat(F.lit("<think>{no}</think> Answer: ```json\n"), "props", F.lit("\n```"))
    return rows.select("event_id", jsontext.extract_json(wrapped).alias("found"), jsontext.repair_json(F.expr("left(props, length(props) - 1)")).alias("repaired"))


def newest_memories(spark, d):
    """The 20 newest documents of each source by id."""
    from heron.operators.logs import newest

    return newest(_docs(spark, d).select("id", "source"), "source", [F.desc("id")], 20)


def ranked_sources(spark, d):
    w = Window.partitionBy("source").orderBy(F.desc("n_chars"), "id")
    return _docs(spark, d).select("id", "source", F.row_number().over(w).alias("rank")).where("rank <= 3")


QUERIES = {
    "bm25_search": bm25, "bm25_stats": bm25_stats, "bm25_postings": postings, "bm25_maintained": maintained, "bm25_changed": maintained_search, "bm25_bounded": bounded_search, "hybrid_maintained": hybrid_maintained, "stem_counts": stems, "hybrid_weighted": hybrid_weighted, "hybrid_rrf": hybrid_rrf, "search_documents": search_documents, "search_rerank": reranked, "prompt_cache": prompt_cache,
    "pii_counts": pii_counts, "pii_redact": pii_redact, "pii_mask": pii_mask, "pii_find": pii_find, "dup_exact": dup_exact, "clf_confusion": clf_confusion, "clf_accuracy": clf_accuracy, "clf_scores": clf_scores, "clf_averages": clf_averages,
    "rouge_1": rouge_1, "rouge_2": rouge_2, "rouge_l": rouge_l, "bleu_1": bleu, "html_text": html_text, "html_meta": html_meta, "html_slug": html_slug, "chunk_windows": chunk_windows, "chunk_estimate": chunk_estimate,
    "chunk_recursive": chunk_recursive, "chunk_markdown": chunk_markdown, "chunk_code": chunk_code, "chunk_stats": chunk_stats, "clauses": clause_lists, "code_language": code_languages, "text_language": text_language, "ingest": ingest_documents,
    "zero_shot": zero_shot, "prompt_keys": prompts, "ages_and_sizes": ages, "encrypt_roundtrip": encrypted, "dp_labels": randomized, "content_hash": content_hash, "format_jsonl": roundtrip_jsonl, "format_nested": roundtrip_nested,
    "format_parallel": roundtrip_parallel, "format_csv": roundtrip_csv, "import_counts": import_counts, "json_value": json_props, "json_found": json_found, "newest_memories": newest_memories, "top_of_source": ranked_sources,
}

_TOKENS = "list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^a-z0-9]+'), lambda w: len(w) >= 2)"
_ASKED = f"asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({_TOKENS}) AS term FROM benchmark WHERE item_id % 20 = 0) GROUP BY ALL)"
_BM25 = f"""WITH {_ASKED}, t AS (SELECT doc_id AS id, {_TOKENS} AS terms FROM documents), s AS (SELECT count(*) AS n, avg(len(terms)) AS avg_dl FROM t),
    p AS (SELECT id, len(terms) AS dl, unnest(terms) AS term FROM t), h AS (SELECT id, dl, term, count(*) AS tf FROM p WHERE term IN (SELECT term FROM asked) GROUP BY ALL), f AS (SELECT term, count(*) AS df FROM h GROUP BY term),
    b AS (SELECT query_id, id, round(sum(times * ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * dl / avg_dl))), 9) AS score FROM asked JOIN h USING (term) JOIN f USING (term), s GROUP BY query_id, id HAVING score > 0),
    r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM b)"""
_CHANGED = "(SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN text || ' newword' ELSE text END AS text FROM documents WHERE doc_id % 6 != 3)"
_HYBRID = "(SELECT doc_id, text FROM documents JOIN embeddings ON doc_id = vec_id WHERE doc_id % 5 != 0 OR doc_id % 10 = 0)"
_VEC = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), vr AS (SELECT q.id AS query_id, e.id, list_cosine_similarity(e.v, q.v) AS score, row_number() OVER (PARTITION BY q.id ORDER BY list_cosine_similarity(e.v, q.v) DESC, e.id) AS rank FROM e, e q WHERE q.id % 20 = 0)"
_LABELLED = "p AS (SELECT quality AS label, CASE WHEN length(text) >= 1000 THEN 1 ELSE 0 END AS prediction FROM documents JOIN labels USING (doc_id))"
_SCORES = f"""WITH {_LABELLED}, c AS (SELECT unnest([0, 1]) AS class), k AS (SELECT class, count(*) FILTER (label = class AND prediction = class) AS tp, count(*) FILTER (label != class AND prediction = class) AS fp,
    count(*) FILTER (label = class AND prediction != class) AS fn, count(*) FILTER (label != class AND prediction != class) AS tn, count(*) FILTER (label = class) AS support FROM p, c GROUP BY class),
    s AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 0.0::DOUBLE ELSE tp / (tp + fn) END AS recall FROM k),
    z AS (SELECT *, CASE WHEN precision + recall = 0 THEN 0.0::DOUBLE ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM s)"""
_WORDS = "list_filter(regexp_split_to_array(lower(text), '\\s+'), lambda w: w != '')"


def _rouge(n: int) -> str:
    grams = "w" if n == 1 else "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    return f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), g AS (SELECT item_id, unnest({grams}) AS g FROM b), k AS (SELECT item_id, g, count(*) AS n FROM g GROUP BY ALL),
        t AS (SELECT item_id, sum(n) AS t FROM k GROUP BY item_id), m AS (SELECT a.item_id, sum(least(a.n, b.n)) AS m FROM k a JOIN k b ON b.item_id = a.item_id + 1 AND a.g = b.g GROUP BY a.item_id)
        SELECT a.item_id AS pair_id, round(coalesce(2 * m / (x.t + y.t), 0), 6)::DOUBLE AS rouge FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1 LEFT JOIN m ON m.item_id = a.item_id LEFT JOIN t x ON x.item_id = a.item_id LEFT JOIN t y ON y.item_id = b.item_id"""


def _re(pattern: str) -> str:
    return pattern.replace("'", "''")


def _redacted() -> str:
    out = "text"
    for k in X.DEFAULT_PII:
        out = f"regexp_replace({out}, '{_re(X.PII[k])}', '{X.REPLACEMENTS[k]}', 'g')"
    return out


def _html() -> str:
    out = "coalesce(html, '')"
    for tag in html.IGNORED:
        out = f"regexp_replace(regexp_replace({out}, '<{tag}[^>]*>.*?</{tag}>', '', 'gis'), '<{tag}[^>]*/>', '', 'gis')"
    out = f"regexp_replace(regexp_replace({out}, '<!--.*?-->', '', 'gs'), '<[^>]+>', ' ', 'g')"
    for entity, char in html.ENTITIES.items():
        out = f"regexp_replace({out}, '{_re(entity)}', '{_re(char)}', 'gi')"
    return f"trim(regexp_replace({out}, '\\s+', ' ', 'g'))"


_ROUND = "SELECT vec_id AS id, 'text ' || vec_id AS text, label::BIGINT AS label, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings"
_TITLE = "CASE WHEN regexp_matches(html, '<title[^>]*>.*?</title>', 'is') THEN trim(regexp_extract(html, '<title[^>]*>(.*?)</title>', 1, 'is')) END"
_WINDOWS = "w AS (SELECT doc_id AS id, s AS start, trim(substr(text, s + 1, 500), ' ') AS t FROM documents, unnest(range(0, CAST(length(text) AS BIGINT), 450)) u(s))"
_BLANK = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"


def _chunks() -> str:
    """Common tables up to c(id, at, text, start, finish): pieces by nested cuts, then a greedy walk over them, piece by piece; a place is that of the n-th character that isn't white."""
    pieces = "[t]"
    for separator in chunking.SEPARATORS:
        pattern = f"(?s).*?{re.escape(separator)}|.+" if separator else f"(?s).{{1,{chunking.SIZE}}}"
        pieces = f"flatten(list_transform({pieces}, lambda p: CASE WHEN length(p) <= {chunking.SIZE} THEN [p] ELSE regexp_extract_all(p, '{pattern}') END))"
    solid = lambda x: f"length(regexp_replace({x}, '{_BLANK}+', '', 'g'))"
    full, last = f"length(now) + length(piece) + 1 > {chunking.SIZE}", f"right(now, {chunking.OVERLAP})"
    tail = f"CASE WHEN length(now) <= {chunking.OVERLAP} THEN now WHEN strpos({last}, ' ') > 0 THEN substr({last}, strpos({last}, ' ') + 1) ELSE {last} END"
    return f"""d AS (SELECT doc_id AS id, text, regexp_replace(text, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS t FROM documents), e AS (SELECT id, unnest({pieces}) AS x, generate_subscripts({pieces}, 1) AS i FROM d WHERE t <> ''),
        p AS (SELECT id, row_number() OVER (PARTITION BY id ORDER BY i) AS k, piece, sum({solid("piece")}) OVER (PARTITION BY id ORDER BY i) AS seen FROM (SELECT id, i, regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g') AS piece FROM e) WHERE piece <> ''),
        f AS (SELECT id, k, piece AS now, 0 AS nth, NULL::VARCHAR AS done FROM p WHERE k = 1
            UNION ALL SELECT f.id, p.k, CASE WHEN NOT {full} THEN now || ' ' || piece WHEN ({tail}) = '' THEN piece ELSE ({tail}) || ' ' || piece END, CASE WHEN {full} THEN nth + 1 ELSE nth END, CASE WHEN {full} THEN now END FROM f JOIN p ON p.id = f.id AND p.k = f.k + 1),
        n AS (SELECT id, max(k) AS n, arg_max(now, k) AS rest, max(nth) AS top FROM f GROUP BY id),
        g AS (SELECT id, nth - 1 AS nth, done AS text, k - 1 AS k FROM f WHERE done IS NOT NULL UNION ALL SELECT id, top, rest, n FROM n),
        h AS (SELECT g.id, g.nth, CASE WHEN top > 0 AND g.nth = top - 1 AND length(rest) < {chunking.LEAST} THEN g.text || ' ' || rest ELSE g.text END AS text, CASE WHEN top > 0 AND g.nth = top - 1 AND length(rest) < {chunking.LEAST} THEN n ELSE g.k END AS k, n, (top = 0 OR g.nth < top OR length(rest) >= {chunking.LEAST}) AS stays, g.k AS own, {solid("g.text")} AS own_size FROM g JOIN n USING (id)),
        s AS (SELECT id, list_transform(list_filter(list_zip(string_split(text, ''), range(length(text))), lambda z: NOT regexp_full_match(z[1], '{_BLANK}')), lambda z: z[2]) AS places FROM d WHERE t <> ''),
        c AS (SELECT h.id, CAST(h.nth AS INTEGER) AS nth, CASE WHEN h.n = 1 THEN h.text ELSE trim(regexp_replace(h.text, '{_BLANK}+', ' ', 'g'), ' ') END AS text, CAST(places[CAST(q.seen - own_size + 1 AS BIGINT)] AS INTEGER) AS start, CAST(places[CAST(r.seen AS BIGINT)] + 1 AS INTEGER) AS finish
            FROM h JOIN p r ON r.id = h.id AND r.k = h.k JOIN p q ON q.id = h.id AND q.k = h.own JOIN s ON s.id = h.id WHERE stays)"""


def _languages() -> str:
    held = lambda rule: " AND ".join("(" + " OR ".join(f"contains({part}, '{_re(m)}')" for m in marks) + ")" for part, marks in rule)
    cases = " ".join(f"WHEN {held(rule)} THEN '{name}'" for name, rule in chunking.LANGUAGES)
    lines = ", ".join("'" + _re(c) + "'" for c in _CODE)
    return f"""WITH t AS (SELECT page_id, ([{lines}])[page_id % {len(_CODE)} + 1] || chr(10) || html AS text FROM pages), h AS (SELECT *, lower(array_to_string(string_split(text, chr(10))[1:50], chr(10))) AS head FROM t)
        SELECT page_id, CASE {cases} ELSE 'generic' END AS language FROM h"""


SQL = {
    "bm25_search": f"{_BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10",
    "bm25_bounded": f"{_BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10",
    "bm25_changed": f"{_BM25.replace('FROM documents', 'FROM ' + _CHANGED)} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM r WHERE rank <= 10",
    "hybrid_maintained": f"""{_BM25.replace('FROM documents', 'FROM ' + _HYBRID)}, q AS (SELECT item_id AS query_id, embedding::DOUBLE[] AS v FROM benchmark JOIN embeddings ON item_id = vec_id WHERE item_id % 20 = 0),
        e AS (SELECT vec_id AS id, list_transform(embedding::DOUBLE[], lambda x: CASE WHEN vec_id % 10 = 0 THEN -x ELSE x END) AS v FROM embeddings WHERE vec_id IN (SELECT doc_id FROM {_HYBRID})),
        vs AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY list_cosine_similarity(e.v, q.v) DESC, id) AS rank FROM q, e),
        u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS p FROM vs WHERE rank <= 30 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM r SEMI JOIN q USING (query_id) WHERE rank <= 30),
        z AS (SELECT query_id, id, round(sum(p), 9) AS score FROM u GROUP BY ALL) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z) WHERE rank <= 10""",
    "code_language": _languages(),
    "bm25_stats": f"WITH t AS (SELECT {_TOKENS} AS terms FROM documents) SELECT count(*) AS n_docs, round(avg(len(terms)), 6) AS avg_dl, (SELECT count(DISTINCT term) FROM (SELECT unnest(terms) AS term FROM t)) AS vocabulary FROM t",
    "bm25_maintained": f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOKENS.replace("text", "body")}) AS term FROM (SELECT doc_id, CASE WHEN doc_id % 6 IN (0, 1) THEN text || ' newword' ELSE text END AS body FROM documents WHERE doc_id % 6 != 3)) GROUP BY term",
    "bm25_postings": f"SELECT term, count(DISTINCT id) AS df, count(*) AS tf FROM (SELECT doc_id AS id, unnest({_TOKENS}) AS term FROM documents) GROUP BY term",
    "stem_counts": "WITH t AS (SELECT unnest(" + _TOKENS + ") AS w FROM documents), s AS (SELECT CASE " + " ".join(f"WHEN length(w) > {len(s) + 2} AND ends_with(w, '{s}') THEN left(w, length(w) - {len(s)})" for s in X.SUFFIXES) + " ELSE w END AS stem FROM t) SELECT stem, count(*) AS n FROM s WHERE stem NOT IN (" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + ") GROUP BY stem",
    "hybrid_weighted": f"""{_BM25}, {_VEC}, v AS (SELECT query_id, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM vr WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id)),
        k AS (SELECT query_id, id, score, CASE WHEN max(score) OVER w = min(score) OVER w THEN 1.0 ELSE (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) END AS x FROM r WHERE rank <= 30 WINDOW w AS (PARTITION BY query_id)),
        z AS (SELECT coalesce(v.query_id, k.query_id) AS query_id, coalesce(v.id, k.id) AS id, round(0.7 * coalesce(v.x, 0) + 0.3 * coalesce(k.x, 0), 9) AS score, v.score AS vector_score, k.score AS keyword_score FROM v FULL JOIN k ON v.query_id = k.query_id AND v.id = k.id)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score, round(vector_score, 6) AS vector_score, round(keyword_score, 6) AS keyword_score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z) WHERE rank <= 10""",
    "hybrid_rrf": f"""{_BM25}, {_VEC}, u AS (SELECT query_id, id, 1.0::DOUBLE / (60 + rank) AS p FROM vr WHERE rank <= 30 UNION ALL SELECT query_id, id, 1.0::DOUBLE / (60 + rank) FROM r WHERE rank <= 30), z AS (SELECT query_id, id, round(sum(p), 9) AS score FROM u GROUP BY ALL)
        SELECT query_id, CAST(rank AS INTEGER) AS rank, id, round(score, 9) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM z) WHERE rank <= 10""",
    "search_documents": f"{_BM25} SELECT query_id, CAST(rank AS INTEGER) AS rank, id, lang, source FROM r JOIN documents ON doc_id = id WHERE rank <= 10",
    "search_rerank": f"{_BM25}, x AS (SELECT query_id, id, -n_chars::DOUBLE AS score FROM r JOIN documents ON doc_id = id WHERE rank <= 10) SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM x) WHERE rank <= 5",
    "prompt_cache": "WITH t AS (SELECT conv_id, turn, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS k FROM (SELECT conv_id, turn, text FROM conversations WHERE role = 'user' UNION ALL SELECT conv_id + 1000000, turn, '  ' || replace(text, ' ', E' \\n ') FROM conversations WHERE role = 'user')), f AS (SELECT *, first_value(conv_id) OVER w AS hit_conv, first_value(turn) OVER w AS hit_turn FROM t WINDOW w AS (PARTITION BY k ORDER BY conv_id, turn)) SELECT conv_id, turn, hit_conv, hit_turn FROM f WHERE conv_id != hit_conv OR turn != hit_turn",
    "pii_counts": "SELECT " + ", ".join(f"CAST(sum(len(regexp_extract_all(text, '{_re(p)}'))) AS BIGINT) AS {k}" for k, p in X.PII.items()) + ", count(*) FILTER (" + " OR ".join(f"regexp_matches(text, '{_re(X.PII[k])}')" for k in X.DEFAULT_PII) + ") AS documents FROM documents",
    "pii_redact": f"SELECT doc_id AS id, md5({_redacted()}) AS redacted_md5 FROM documents",
    "pii_mask": f"WITH m AS (SELECT DISTINCT doc_id AS id, unnest(regexp_extract_all(text, '{_re(X.PII['email'])}')) AS match FROM documents) SELECT id, match, CASE WHEN length(match) <= 4 THEN repeat('*', length(match)) WHEN instr(match, '@') > 3 THEN left(match, 1) || repeat('*', instr(match, '@') - 3) || substr(match, instr(match, '@') - 1) ELSE repeat('*', length(match)) END AS masked FROM m",
    "dup_exact": "SELECT min(doc_id) AS first_id, count(*) AS n, CAST(max(length(text)) AS INTEGER) AS chars FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1",
    "clf_confusion": f"WITH {_LABELLED} SELECT label, prediction, count(*) AS n FROM p GROUP BY ALL",
    "clf_accuracy": f"WITH {_LABELLED} SELECT round(avg(CASE WHEN label = prediction THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM p",
    "clf_scores": f"{_SCORES} SELECT class::BIGINT AS class, tp, fp, fn, tn, support, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM z WHERE tp + fp + fn > 0",
    "clf_averages": f"{_SCORES} SELECT round(avg(precision), 6) AS precision, round(avg(recall), 6) AS recall, round(avg(f1), 6) AS f1_macro, round(sum(f1 * support) / sum(support), 6) AS f1_weighted, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM z WHERE tp + fp + fn > 0",
    "rouge_1": _rouge(1),
    "rouge_2": _rouge(2),
    "bleu_1": f"""WITH b AS (SELECT item_id, {_WORDS} AS w FROM benchmark), k AS (SELECT item_id, g, count(*) AS n FROM (SELECT item_id, unnest(w) AS g FROM b) GROUP BY ALL),
        m AS (SELECT a.item_id, sum(least(a.n, b.n)) AS m FROM k a JOIN k b ON b.item_id = a.item_id + 1 AND a.g = b.g GROUP BY a.item_id)
        SELECT a.item_id AS pair_id, round(coalesce(m, 0) / len(a.w) * CASE WHEN len(a.w) >= len(b.w) THEN 1.0 ELSE exp(1 - len(b.w) / len(a.w)) END, 6)::DOUBLE AS bleu FROM b a JOIN b ON b.item_id = a.item_id + 1 LEFT JOIN m ON m.item_id = a.item_id""",
    "html_text": f"SELECT page_id, md5({_html()}) AS text_md5, {_TITLE} AS title FROM pages",
    "html_meta": "SELECT 'author' AS name, 'a' || page_id % 3 AS content, count(*) AS n FROM pages GROUP BY ALL UNION ALL SELECT 'og:kind', 'k' || page_id % 2, count(*) FROM pages GROUP BY ALL",
    "html_slug": f"SELECT page_id, left(regexp_replace(regexp_replace(lower({_TITLE}), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g'), 50) AS slug FROM pages",
    "chunk_windows": f"WITH {_WINDOWS} SELECT id, count(*) AS n, CAST(sum(length(t)) AS BIGINT) AS chars, max(start)::BIGINT AS last FROM w WHERE length(t) > 0 GROUP BY id",
    "chunk_recursive": f"""WITH RECURSIVE {_chunks()} SELECT 'chunk_' || id || '_' || nth AS chunk_id, id, nth AS "at", start, finish AS "end", text FROM c""",
    "chunk_stats": f"WITH RECURSIVE {_chunks()} SELECT count(*) AS n_chunks, CAST(coalesce(sum(length(text)), 0) AS BIGINT) AS total_chars, CAST(coalesce(floor(avg(length(text)) + 0.5), 0) AS BIGINT) AS avg_size, CAST(coalesce(min(length(text)), 0) AS INTEGER) AS min_size, CAST(coalesce(max(length(text)), 0) AS INTEGER) AS max_size FROM c",
    "ingest": f"WITH RECURSIVE {_chunks()} SELECT 'chunk_' || id || '_' || nth AS chunk_id, id, nth AS \"at\", 256 AS dimensions, 1.0::DOUBLE AS norm FROM c",
    "chunk_estimate": "SELECT doc_id AS id, CAST(CASE WHEN length(text) <= 0 THEN 0 WHEN length(text) <= 500 THEN 1 ELSE ceil(length(text) / 450.0) END AS BIGINT) AS chunks FROM documents",
    "zero_shot": "WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT e.vec_id, l.vec_id::VARCHAR AS label, list_cosine_similarity(e.v, l.v) AS score FROM e, e l WHERE l.vec_id < 4) SELECT vec_id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label DESC) AS k FROM s) WHERE k = 1",
    "prompt_keys": "SELECT conv_id, turn, md5(lower(regexp_replace(trim(text), '\\s+', ' ', 'g'))) AS key FROM conversations",
    "encrypt_roundtrip": "SELECT count(*) AS n, count(*) AS same, 0::BIGINT AS leaks FROM documents",
    "dp_labels": "SELECT count(*) AS n, 0.9::DOUBLE AS kept FROM labels",
    "content_hash": "SELECT doc_id AS id, sha256(text) AS sha256, base64(unhex(sha256(text))) AS digest FROM documents",
    "format_jsonl": _ROUND, "format_nested": _ROUND, "format_parallel": _ROUND, "format_csv": _ROUND,
    "import_counts": "SELECT count(*) AS n, count(*) AS with_vector, 0::BIGINT AS text_only, CAST(min(len(embedding)) AS INTEGER) AS least_dimensions, CAST(max(len(embedding)) AS INTEGER) AS most_dimensions FROM embeddings",
    "json_value": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
    "json_found": "SELECT event_id, replace(props, ' ', '') AS found, replace(props, ' ', '') AS repaired FROM events",
    "newest_memories": "SELECT id, source FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS k FROM documents) WHERE k <= 20",
    "top_of_source": "SELECT id, source, CAST(rank AS INTEGER) AS rank FROM (SELECT doc_id AS id, source, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents) WHERE rank <= 3",
}
