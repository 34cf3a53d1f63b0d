"""Language ID by Bayesian evidence fusion: text likelihoods, declared markup language, address suffix and host priors in one posterior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.llm.common import mix, saved, small_batches, small_side, table, with_fields

#: Hash buckets of the letter trigrams; languages at most (more are an error); documents (about) of each language that the text model is fitted on.
BUCKETS, MOST_LANGUAGES, FIT_DOCUMENTS = 1 << 15, 256, 4000
#: Name of the class of texts in none of the languages, and the share of the buckets that it is taken to use evenly.
OTHER, OTHER_SHARE = "other", 0.6
#: A letter, as trigrams() sees it; values of the hash that chooses documents.
LETTER, PLACES = r"[A-Za-z\x{AA}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{1FFF}\x{2070}-\x{10FFFF}]", 1 << 40
#: Trigrams of a text overlap and depend on each other: a few count by the factor TEMPER, more of them ever less (see TextModel.score), which is felt from about BEND on.
TEMPER, BEND = 0.25, 400
#: Characters of a text that are looked at at once.
RUN = 1 << 20
#: Pseudo-documents by which a host leans on its suffix, a suffix on the corpus, and a declaration on chance.
LEAN = 20.0
#: Posterior that a kept document needs at least, and letters that its text needs.
CERTAIN, LETTERS = 0.6, 1


def trigrams(text: str) -> np.ndarray:
    """Buckets of the trigrams of lower-cased letters; anything else is one blank."""
    runs = list(trigram_runs(text))
    return np.concatenate(runs) if runs else np.zeros(0, np.int64)


def trigram_runs(text: str, run: int = RUN) -> Iterator[np.ndarray]:
    """The same in runs of up to `run` characters, so that a very long text needs no long arrays; texts without letters have none."""
    before, blanks = np.array([32], np.uint32), True
    for i in range(0, len(text), run):
        points = np.frombuffer(text[i : i + run].lower().encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = ((points >= 97) & (points <= 122)) | (points >= 0xAA) & (points != 0xD7) & (points != 0xF7) & ((points < 0x2000) | (points > 0x206F))
        kept = np.concatenate([before, np.where(letter, points, 32)])
        kept = kept[~((kept == 32) & np.concatenate([[False], kept[:-1] == 32]))]
        if i + run >= len(text):
            kept = np.concatenate([kept, [32]]) if kept[-1] != 32 else kept
        blanks = blanks and not (kept != 32).any()
        if not blanks and len(kept) > 2:
            wide = kept.astype(np.uint64)
            yield (mix(wide[:-2] << np.uint64(42) | wide[1:-1] << np.uint64(21) | wide[2:]) >> np.uint64(64 - (BUCKETS - 1).bit_length())).astype(np.int64)
        before = kept[-2:]


class TextModel:
    """Log likelihoods of trigram buckets: one row for each language, its name in `languages`."""

    def __init__(self, languages: list[str], logs: np.ndarray):
        self.languages, self.logs = languages, logs

    def score(self, text: str | None) -> tuple[np.ndarray, int]:
        """Tempered log likelihood of each language, and the number of trigrams.

        All n trigrams are read, and weigh together as TEMPER * BEND * log(1 + n / BEND) independent ones: one rule for
        texts of any length, by which a longer text is always the better witness, but less than in proportion, as its
        trigrams repeat each other.
        """
        sums, n = np.zeros(len(self.languages)), 0
        for found in trigram_runs(text or ""):
            sums += self.logs[:, found].sum(axis=1, dtype=np.float64)
            n += len(found)
        return (sums * (TEMPER * BEND * np.log1p(n / BEND) / n) if n else sums).astype(np.float32), n


def fit(docs: DataFrame, label_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", most: int = FIT_DOCUMENTS) -> TextModel:
    """A trigram model of all labelled languages of docs and of OTHER, each language from about `most` documents chosen by a hash of id and text.

    Labels are counted over all rows with letters, so a rare language is fitted on all its documents; the sample of the
    others is the documented bound of this fit. More than MOST_LANGUAGES labels raise a ValueError. Counts are summed on
    the executors, so the driver gets languages * BUCKETS numbers at most. A label OTHER names no language.
    """
    small_batches(docs.sparkSession)
    text = F.col(text_col).cast("string")
    labelled = docs.select(F.lower(F.col(label_col).cast("string")).alias("label"), text.alias("text"), F.pmod(F.xxhash64(F.col(id_col), text, F.lit(61)), F.lit(PLACES)).alias("at"))
    labelled = labelled.where((F.col("label") != OTHER) & F.col("text").rlike(LETTER))
    found = labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("at").alias("least")).limit(MOST_LANGUAGES + 1).collect()
    if len(found) > MOST_LANGUAGES:
        raise ValueError(f"{label_col} has more than {MOST_LANGUAGES} labels")
    if not found:
        return TextModel([], np.zeros((0, BUCKETS), np.float32))
    ends = [F.lit(y) for x in found for y in (x.label, max(x.least + 1, PLACES * most // max(most, x.n)))]
    chosen = labelled.where(F.col("at") < F.create_map(*ends)[F.col("label")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for found in trigram_runs(text):
                    sums[label] = sums.get(label, 0) + np.bincount(found, minlength=BUCKETS)
        for label, counts in sums.items():
            at = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([label] * len(at), pa.string()), pa.array(at), pa.array(counts[at])], names=["label", "bucket", "n"])

    counted = saved(chosen.mapInArrow(run, "label string, bucket long, n long").groupBy("label", "bucket").agg(F.sum("n").alias("n")))
    languages = sorted(x.label for x in found)
    place, counts = {x: i for i, x in enumerate(languages)}, np.zeros((len(languages), BUCKETS))
    for x in counted.toLocalIterator():
        counts[place[x.label], x.bucket] = x.n
    smooth = counts + 0.5
    logs = np.vstack([np.log(smooth / smooth.sum(axis=1, keepdims=True)), np.full((1, BUCKETS), -np.log(OTHER_SHARE * BUCKETS))])
    return TextModel([*languages, OTHER], logs.astype(np.float32))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def suffix_of(host: Column) -> Column:
    return F.when(host.contains("."), F.substring_index(host, ".", -1))


def declared_of(html: Column) -> Column:
    """The primary subtag of the page's lang attribute, lower case; null if it has none."""
    found = F.lower(F.regexp_extract(html, r"(?i)<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    return F.when(found != "", found)


def identified(rows: DataFrame, model: TextModel, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None, suffix: Column | None = None) -> DataFrame:
    """(id, row_hash, language, posterior, text_language, n_trigrams, kept) for each row.

    log posterior = tempered text log likelihood + log P(declared | language) + log prior of the host. The prior of a
    host is Dirichlet-smoothed towards that of its suffix, and that towards the corpus'; P(declared | language) is
    smoothed towards the share of the declaration. These counts are grouped aggregates of the text's own verdicts over
    all rows. A missing declaration, suffix or host adds nothing of its own. A text in none of the model's languages is
    OTHER. kept: the text has letters and the best language isn't OTHER and has a posterior of at least CERTAIN.

    Text is scored once and slim rows are saved; a hot host is only summed (with partial sums), and its joined side
    has one row. A very long text is read in runs of RUN characters. Null and empty texts have no language of their own and aren't kept; rows that repeat an id are each
    judged; row_hash tells apart rows of one id by their text. An empty table gives no rows; without a labelled
    language nothing is kept. Other columns are ignored.
    """
    small_batches(rows.sparkSession)
    languages, n = model.languages, len(model.languages)
    none = F.lit(None).cast("string")
    slim = rows.select(
        F.col(id_col).alias("id"), F.xxhash64(F.col(text_col).cast("string")).alias("row_hash"), F.lower(none if declared is None else declared.cast("string")).alias("declared"),
        F.coalesce(none if host is None else host.cast("string"), F.lit("")).alias("host"), F.coalesce(none if suffix is None else suffix.cast("string"), F.lit("")).alias("suffix"), F.col(text_col).cast("string").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = [model.score(t) for t in batch.column(5).to_pylist()]
            best = [languages[int(np.argmax(s))] if k and n else None for s, k in scored]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array([s - s.max() if n else s for s, _ in scored], pa.list_(pa.float32())), pa.array([k for _, k in scored], pa.int64()), pa.array(best, pa.string())], names=[*batch.schema.names[:5], "scores", "n_trigrams", "text_language"])

    schema = with_fields(slim.drop("text"), "scores array<float>, n_trigrams long, text_language string")
    scored = saved(slim.mapInArrow(run, schema))
    if not n:
        return scored.select("id", "row_hash", none.alias("language"), F.lit(None).cast("double").alias("posterior"), "text_language", "n_trigrams", F.lit(False).alias("kept"))
    known = F.when(F.col("declared").isin(languages), F.col("declared")).when(F.col("declared").isNotNull(), F.lit(OTHER))
    scored = scored.withColumn("declared", known)
    counts = saved(scored.where(F.col("text_language").isNotNull()).groupBy("host", "suffix", "declared", "text_language").agg(F.count("*").alias("n")))

    # Languages and declarations are at most MOST_LANGUAGES + 1 values, so these come to the driver.
    overall = {x.text_language: x.n for x in counts.groupBy("text_language").agg(F.sum("n").alias("n")).collect()}
    total = max(1, sum(overall.values()))
    base = [(overall.get(a, 0) + 1.0) / (total + n) for a in languages]
    told, place = np.zeros((n, n)), {x: i for i, x in enumerate(languages)}
    for x in counts.where(F.col("declared").isNotNull()).groupBy("declared", "text_language").agg(F.sum("n").alias("n")).collect():
        told[place.get(x.declared, n - 1), place[x.text_language]] = x.n
    share = (told.sum(axis=1, keepdims=True) + 1.0) / (told.sum() + n)
    rows_of = np.log((told + LEAN * share) / (told.sum(axis=0) + LEAN)).tolist()
    evidence = rows.sparkSession.createDataFrame(list(zip(languages, rows_of)), "declared string, evidence array<double>")

    def by(*keys: str) -> DataFrame:
        """Counts of the languages for each key, in an array."""
        sums = counts.groupBy(*keys, "text_language").agg(F.sum("n").cast("double").alias("n"))
        entries = sums.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("text_language", "n"))).alias("own"))
        return entries.withColumn("own", F.transform(F.lit(languages), lambda a: F.coalesce(F.try_element_at("own", a), F.lit(0.0))))

    sum_of = lambda own: F.aggregate(own, F.lit(0.0), lambda s, x: s + x)
    lean = lambda own, up: F.zip_with(own, up, lambda o, u: (o + F.lit(LEAN) * u) / (sum_of(own) + LEAN))
    suffix_prior = by("suffix").select("suffix", F.when(F.col("suffix") == "", F.lit(base)).otherwise(lean(F.col("own"), F.lit(base))).alias("up"))
    host_prior = by("host", "suffix").join(suffix_prior, "suffix").select("host", "suffix", F.when(F.col("host") == "", F.col("up")).otherwise(lean(F.col("own"), F.col("up"))).alias("prior"))

    joined = scored.join(small_side(saved(host_prior)), ["host", "suffix"], "left").withColumn("prior", F.coalesce("prior", F.lit(base)))
    joined = joined.join(F.broadcast(evidence), "declared", "left").withColumn("evidence", F.coalesce("evidence", F.lit([0.0] * n)))
    logs = F.zip_with(F.zip_with(F.col("scores"), "evidence", lambda s, e: s.cast("double") + e), "prior", lambda s, p: s + F.log(p))
    joined = joined.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    posterior = 1 / F.aggregate("logs", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top")))
    best = F.element_at(F.lit(languages), F.array_position("logs", F.col("top")).cast("int"))
    has_text = F.col("n_trigrams") >= LETTERS
    joined = joined.withColumn("posterior", F.when(has_text, posterior))
    return joined.select("id", "row_hash", F.when(has_text, best).alias("language"), "posterior", "text_language", "n_trigrams", F.coalesce(has_text & (F.col("posterior") >= CERTAIN) & (best != OTHER), F.lit(False)).alias("kept"))


def documents_identified(docs: DataFrame) -> DataFrame:
    """Languages of documents by all kinds of evidence that they carry: the text, the markup language of a text that is a page, and source as the host it comes from, with its suffix; of a source that is an address, its host.

    lang is what the text model is fitted on, so it is no declaration of its own here. A source without a dot has no
    suffix, and a text that doesn't begin as a page declares nothing, whatever markup it quotes.
    """
    text, source = F.col("text").cast("string"), F.col("source").cast("string")
    host = F.when(host_of(source) != "", host_of(source)).otherwise(source)
    declared = F.when(text.rlike(r"(?i)\A\s*<(!doctype\s+html|html)\b"), declared_of(text))
    return identified(docs, fit(docs), declared=declared, host=host, suffix=suffix_of(host))


def accepted(docs: DataFrame) -> DataFrame:
    """docs without those whose language is rejected (see identified, also for nulls, repeated rows and empty tables); columns, of any names, stay as they are."""
    gone = documents_identified(docs).where(~F.col("kept")).select("id", "row_hash").distinct()
    here = docs.select(F.struct("*").alias("doc"), F.col("doc_id").alias("id"), F.xxhash64(F.col("text").cast("string")).alias("row_hash"))
    gone = small_side(saved(gone))
    return here.alias("a").join(gone.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.row_hash") == F.col("b.row_hash")), "left_anti").select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = documents_identified(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "n_trigrams", "kept")


def pages_query(spark, sf_dir: str) -> DataFrame:
    """The same of pages: the markup's lang attribute, the suffix and the host of the address; the text model is that of the documents."""
    from heron.llm.op02_html import extracted

    model = fit(table(spark, sf_dir, "documents"))
    pages = table(spark, sf_dir, "pages")
    host = host_of(F.col("url"))
    texts = extracted(pages.select(F.struct("page_id", host.alias("host"), declared_of(F.col("html")).alias("declared")).alias("page"), "html"), "page")
    found = identified(texts.select("id.*", "text"), model, "page_id", "text", F.col("declared"), F.col("host"), suffix_of(F.col("host")))
    return found.select(F.col("id").alias("page_id"), "language", F.round("posterior", 6).alias("posterior"), "text_language", "kept")
