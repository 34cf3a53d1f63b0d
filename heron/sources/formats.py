"""Readers and writers of documents and vectors: text, CSV, JSON, JSON lines, nested and parallel-array vector exports."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names under which ids, vectors and texts are looked for, the first that is there.
ID_KEYS, VECTOR_KEYS, TEXT_KEYS = ("id", "_id", "uuid"), ("vector", "embedding", "values", "dense_vector"), ("text", "content", "document", "body")
TEXT_COLUMNS = ("text", "content", "body", "description", "message", "title")


def read_text(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    """(source, part, n_parts, text): a row for each file, or for each trimmed, non-empty part between separators. A file is one row, so it must fit in a task."""
    files = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value"))
    if separator is None:
        return files.select("source", F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.col("value").alias("text"))
    parts = F.filter(F.transform(F.split(F.col("value"), separator_pattern(separator)), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")
    return files.select("source", parts.alias("parts")).select("source", F.size("parts").alias("n_parts"), F.posexplode("parts").alias("part", "text")).select("source", "part", "n_parts", "text")


def separator_pattern(separator: str) -> str:
    return "".join(f"\\{c}" if not c.isalnum() and not c.isspace() else c for c in separator)


def read_csv(spark: SparkSession, paths: str | list[str], text_columns: list[str] | None = None, joined_by: str = " ", id_column: str | None = None, header: bool = True, skip_empty: bool = True) -> DataFrame:
    """(id, text, metadata): the trimmed, non-empty text columns joined; every column goes to the metadata map; with skip_empty rows without text are left out.

    Without text_columns, the first usual text column, else the first column. Quoted fields may hold line ends.
    """
    rows = spark.read.csv(paths, header=header, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False)
    chosen = text_columns or next(([c for c in rows.columns if c.lower() == name] for name in TEXT_COLUMNS[:5] if name in map(str.lower, rows.columns)), rows.columns[:1])
    trimmed = {c: F.trim(F.coalesce(F.col(f"`{c}`"), F.lit(""))) for c in rows.columns}
    text = F.array_join(F.filter(F.array(*[trimmed[c] for c in chosen]), lambda x: x != ""), joined_by)
    metadata = F.create_map(*[x for c, v in trimmed.items() for x in (F.lit(c), v)])
    return rows.select((trimmed[id_column] if id_column else F.lit(None).cast("string")).alias("id"), text.alias("text"), metadata.alias("metadata")).where(F.lit(not skip_empty) | (F.col("text") != ""))


def read_json_records(spark: SparkSession, paths: str | list[str], records: str | None = None) -> DataFrame:
    """(record): a VARIANT for each element of the array at the dotted path `records` (or at the top); a lone object is one record."""
    whole = spark.read.text(paths, wholetext=True).select(F.parse_json("value").alias("v"))
    at = F.variant_get(F.col("v"), "$" + (f".{records}" if records else ""), "variant") if records else F.col("v")
    each = F.coalesce(F.try_variant_get(at, "$", "array<variant>"), F.array(at))
    return whole.select(F.explode(each).alias("record"))


def json_path(dotted: str) -> str:
    """$.a[0].b of a.0.b."""
    return "$" + "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in dotted.split("."))


def value_at(record: str, dotted: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(record), json_path(dotted), kind)


def record_text(record: str, fields: list[str] | None = None, joined_by: str = " ") -> Column:
    """The given fields joined, or the first usual text field, or the record as JSON."""
    if fields:
        return F.array_join(F.filter(F.array(*[F.coalesce(value_at(record, f), F.lit("")) for f in fields]), lambda x: x != ""), joined_by)
    return F.coalesce(*[value_at(record, c) for c in TEXT_COLUMNS], F.to_json(F.col(record)))


def all_strings(value: object, depth: int = 10) -> list[str]:
    """Strings anywhere inside a JSON value, in order, down to a depth."""
    if isinstance(value, str):
        return [value]
    if depth <= 0 or not isinstance(value, (dict, list)):
        return []
    return [s for x in (value.values() if isinstance(value, dict) else value) for s in all_strings(x, depth - 1)]


def strings_udf(depth: int = 10):
    """array<string> of a column of JSON texts."""

    @F.pandas_udf("array<string>")
    def strings(texts):
        return texts.map(lambda t: None if t is None else all_strings(json.loads(t), depth))

    return strings


def _first(v: str, keys: tuple[str, ...], kind: str) -> Column:
    return F.coalesce(*[F.try_variant_get(F.col(v), f"$.{k}", kind) for k in keys])


def parse_jsonl(lines: DataFrame, column: str = "value") -> DataFrame:
    """(id, vector, text, metadata): one object for each line, under the usual names; a line that isn't JSON ends the job.

    metadata is a map of JSON texts: the nested metadata object, then all other keys of the line, which win.
    """
    v = lines.where(F.trim(column) != "").select(F.parse_json(column).alias("v"))
    usual = [*ID_KEYS, *VECTOR_KEYS, *TEXT_KEYS, "metadata", "sparse_values"]
    own = F.map_filter(F.transform_values(F.try_variant_get(F.col("v"), "$", "map<string,variant>"), lambda _, x: F.to_json(x)), lambda k, _: ~k.isin(usual))
    nested = F.coalesce(F.transform_values(F.try_variant_get(F.col("v"), "$.metadata", "map<string,variant>"), lambda _, x: F.to_json(x)), F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(nested, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    return v.select(_first("v", ID_KEYS, "string").alias("id"), _first("v", VECTOR_KEYS, "array<double>").alias("vector"), _first("v", TEXT_KEYS, "string").alias("text"), merged.alias("metadata"))


def parse_nested(whole: DataFrame, column: str = "value") -> DataFrame:
    """(id, vector, text, metadata) of {"vectors": [{id, values, metadata}]} or of such an array; the text comes from the metadata."""
    v = whole.select(F.parse_json(column).alias("v")).select(F.explode(F.coalesce(F.try_variant_get("v", "$.vectors", "array<variant>"), F.try_variant_get("v", "$", "array<variant>"))).alias("v"))
    metadata = F.coalesce(F.transform_values(F.try_variant_get(F.col("v"), "$.metadata", "map<string,variant>"), lambda _, x: F.to_json(x)), F.create_map().cast("map<string,string>"))
    return v.select(F.try_variant_get("v", "$.id", "string").alias("id"), F.try_variant_get("v", "$.values", "array<double>").alias("vector"), F.coalesce(F.try_variant_get("v", "$.metadata.text", "string"), F.try_variant_get("v", "$.metadata.content", "string")).alias("text"), metadata.alias("metadata"))


def parse_parallel(whole: DataFrame, column: str = "value") -> DataFrame:
    """(id, vector, text, metadata) of {"ids": [], "embeddings": [], "metadatas": [], "documents": []}; arrays of other lengths end the job."""
    get = lambda key, kind: F.try_variant_get("v", f"$.{key}", kind)
    v = whole.select(F.parse_json(column).alias("v")).select(get("ids", "array<string>").alias("id"), get("embeddings", "array<array<double>>").alias("vector"), get("documents", "array<string>").alias("text"), get("metadatas", "array<variant>").alias("metadata"))
    n = F.size("id")
    differs = F.lit(False)
    for c in ("vector", "text", "metadata"):
        differs = differs | (F.col(c).isNotNull() & (F.size(c) != n))
    zipped = F.when(differs, F.raise_error(F.lit("arrays differ in length")).cast("array<struct<id:string,vector:array<double>,text:string,metadata:variant>>")).otherwise(F.arrays_zip("id", *[F.coalesce(c, F.array().cast(t)).alias(c) for c, t in (("vector", "array<array<double>>"), ("text", "array<string>"), ("metadata", "array<variant>"))]))
    return v.select(F.explode(zipped).alias("x")).select("x.id", "x.vector", "x.text", F.coalesce(F.transform_values(F.try_variant_get(F.col("x.metadata"), "$", "map<string,variant>"), lambda _, y: F.to_json(y)), F.create_map().cast("map<string,string>")).alias("metadata"))


def parse_csv_vectors(rows: DataFrame) -> DataFrame:
    """(id, vector, text, metadata) of string columns under the usual names; vectors are JSON arrays; other columns are JSON scalars where they read as such."""
    lower = {c.lower(): c for c in rows.columns}
    pick = lambda keys: next((lower[k] for k in keys if k in lower), None)
    i, v, t = pick(ID_KEYS), pick(VECTOR_KEYS), pick(TEXT_KEYS)
    rest = [c for c in rows.columns if c not in (i, v, t)]
    typed = lambda c: F.when(F.lower(c).isin("true", "false"), F.lower(c)).when(F.col(c).try_cast("double").isNotNull(), F.regexp_replace(F.col(c).try_cast("double").cast("string"), r"\.0$", "")).otherwise(F.to_json(F.array(c)).substr(F.lit(2), F.length(F.to_json(F.array(c))) - 2))
    metadata = F.create_map(*[x for c in rest for x in (F.lit(c), typed(c))]) if rest else F.create_map().cast("map<string,string>")
    return rows.select((F.col(i) if i else F.lit(None).cast("string")).alias("id"), (F.from_json(v, "array<double>") if v else F.lit(None).cast("array<double>")).alias("vector"), (F.col(t) if t else F.lit(None).cast("string")).alias("text"), metadata.alias("metadata"))


def detect_format(head: str) -> str | None:
    """nested, parallel, jsonl or csv, by the first lines of a file; null if it is none of them."""
    text = head.lstrip()
    if text[:1] in "{[" and text:
        squeezed = "".join(text.split())
        if '"vectors":[' in squeezed or squeezed.startswith('[{"id"') and '"values":[' in squeezed:
            return "nested"
        if '"ids":[' in squeezed and ('"embeddings":[' in squeezed or '"documents":[' in squeezed):
            return "parallel"
        lines = [x for x in text.split("\n") if x.strip()][:5]
        if all(x.lstrip().startswith("{") for x in lines):
            return "jsonl"
        return None
    first = text.split("\n", 1)[0].lower().split(",")
    return "csv" if len(first) > 1 and set(first) & {*ID_KEYS, *VECTOR_KEYS, *TEXT_KEYS} else None


def detect_path(spark: SparkSession, path: str, lines: int = 5) -> str | None:
    return detect_format("\n".join(r.value for r in spark.read.text(path).limit(lines).collect()))


def read_vectors(spark: SparkSession, path: str, form: str | None = None) -> DataFrame:
    """(id, vector, text, metadata) of any of the vector formats."""
    form = form or detect_path(spark, path)
    if form == "csv":
        return parse_csv_vectors(spark.read.csv(path, header=True, multiLine=True, escape='"'))
    if form == "jsonl":
        return parse_jsonl(spark.read.text(path))
    if form not in ("nested", "parallel"):
        raise ValueError(f"unknown format: {form}")
    return {"nested": parse_nested, "parallel": parse_parallel}[form](spark.read.text(path, wholetext=True))


def convert(spark: SparkSession, source: str, target: str, to: str, form: str | None = None, batch: Column | None = None) -> None:
    """Vectors of one format written in another; nested and parallel ones in files of a batch key's records (a hash of the id, if none is given)."""
    records = read_vectors(spark, source, form)
    if to == "csv":
        return to_csv(records).write.mode("overwrite").csv(target, header=True, escape='"')
    if to == "jsonl":
        return to_jsonl(records).write.mode("overwrite").text(target)
    if to not in ("nested", "parallel"):
        raise ValueError(f"unknown format: {to}")
    key = F.pmod(F.xxhash64("id"), F.lit(256)) if batch is None else batch
    out = {"nested": to_nested, "parallel": to_parallel}[to](records, key)
    return out.repartition("batch").write.partitionBy("batch").mode("overwrite").option("lineSep", "\n").text(target)


def import_counts(records: DataFrame) -> DataFrame:
    """One row: records, with a vector, with text only, dimensions (least and most)."""
    has = F.col("vector").isNotNull()
    return records.agg(F.count("*").alias("n"), F.count(F.when(has, 1)).alias("with_vector"), F.count(F.when(~has & F.col("text").isNotNull(), 1)).alias("text_only"), F.min(F.size("vector")).alias("least_dimensions"), F.max(F.size("vector")).alias("most_dimensions"))


def _value(json_text: Column) -> Column:
    return F.when(json_text.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), json_text, F.lit("}")), "v string")["v"]).otherwise(json_text)


def to_jsonl(records: DataFrame) -> DataFrame:
    """A column value: id, text and vector, then the metadata keys that don't collide with these."""
    inner = F.map_filter("metadata", lambda k, _: ~k.isin("id", "text", "vector"))
    more = F.array_join(F.transform(F.array_sort(F.map_entries(inner)), lambda e: F.concat(F.lit(","), F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"])), "")
    head = F.to_json(F.struct("id", "text", "vector"))
    return records.select(F.concat(F.substring(head, F.lit(1), F.length(head) - 1), more, F.lit("}")).alias("value"))


def to_csv(records: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Columns id, text, vector ([a,b]) and the sorted union of the metadata keys, for df.write.csv."""
    if keys is None:
        keys = sorted(r[0] for r in records.select(F.explode(F.map_keys("metadata"))).distinct().collect())  # column names: a schema, not data
    return records.select("id", "text", F.to_json("vector").alias("vector"), *[_value(F.try_element_at("metadata", F.lit(k))).alias(k) for k in keys if k not in ("id", "text", "vector")])


def to_nested(records: DataFrame, batch: Column) -> DataFrame:
    """(batch, value): {"vectors": [...]} for each batch of records; give a batch key that bounds their number."""
    text = F.when(F.col("text").isNotNull(), F.map_from_arrays(F.array(F.lit("text")), F.array(F.to_json(F.struct(F.col("text").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("text").alias("v")))) - 6)))).otherwise(F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.map_filter("metadata", lambda k, _: k != "text"), text)
    entries = F.array_join(F.transform(F.array_sort(F.map_entries(metadata)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ",")
    one = F.concat(F.lit('{"id":"'), F.col("id"), F.lit('","values":'), F.to_json("vector"), F.lit(',"metadata":{'), entries, F.lit("}}"))
    rows = records.where("vector IS NOT NULL").select(batch.alias("batch"), "id", one.alias("one"))
    return rows.groupBy("batch").agg(F.concat(F.lit('{"vectors":['), F.array_join(F.array_sort(F.collect_list(F.struct("id", "one")))["one"], ","), F.lit("]}")).alias("value"))


def to_parallel(records: DataFrame, batch: Column) -> DataFrame:
    """(batch, value): parallel arrays for each batch of records; give a batch key that bounds their number."""
    rows = records.select(batch.alias("batch"), F.struct("id", "vector", "text", "metadata").alias("r"))
    meta = lambda m: F.concat(F.lit("{"), F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda e: F.concat(F.lit('"'), e["key"], F.lit('":'), e["value"])), ","), F.lit("}"))
    sorted_rows = F.array_sort(F.collect_list(F.struct(F.col("r.id").alias("id"), F.col("r.vector").alias("vector"), F.col("r.text").alias("text"), meta(F.col("r.metadata")).alias("metadata"))))
    return rows.groupBy("batch").agg(sorted_rows.alias("x")).select("batch", F.concat(F.lit('{"ids":'), F.to_json(F.col("x")["id"]), F.lit(',"embeddings":'), F.to_json(F.col("x")["vector"]), F.lit(',"documents":'), F.to_json(F.col("x")["text"]), F.lit(',"metadatas":['), F.array_join(F.col("x")["metadata"], ","), F.lit("]}")).alias("value"))
