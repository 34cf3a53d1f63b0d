"""Document loaders: one interface over text, CSV, JSON and HTML files, chosen by name or by what a file looks like."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heron.sources import formats, html
from heron.sources.records import opened

#: A loader reads paths into (id, text, source, metadata map<string,string>).
Loader = Callable[..., DataFrame]


def text_documents(spark: SparkSession, paths: str | list[str], separator: str | None = None) -> DataFrame:
    parts = formats.read_text(spark, paths, separator)
    metadata = F.create_map(F.lit("partIndex"), F.col("part").cast("string"), F.lit("totalParts"), F.col("n_parts").cast("string"))
    return parts.select(F.concat_ws("#", "source", "part").alias("id"), "text", "source", metadata.alias("metadata"))


def write_texts(rows: DataFrame, path: str, key_col: str, text_col: str = "text") -> int:
    """Writes a file text-<key>.txt for each row into one folder, and gives their number. Keys differ; other characters than letters, digits and -._~ are percent-encoded. A null text is an empty file, a null key the file text.txt.

    Tasks write their files under the names that they keep, so a task that runs again writes the same ones, and no file is moved.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(path)
        system.create_dir(folder, recursive=True)
        for batch in batches:
            for key, text in zip(*(c.to_pylist() for c in batch.columns)):
                with system.open_output_stream(f"{folder}/text{'' if key is None else '-' + quote(key, safe='')}.txt") as f:
                    f.write((text or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    keyed = rows.select(F.col(key_col).cast("string"), F.col(text_col).cast("string"))
    return keyed.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def csv_documents(spark: SparkSession, paths: str | list[str], **options) -> DataFrame:
    return formats.read_csv(spark, paths, **options).select("id", "text", F.lit(None).cast("string").alias("source"), "metadata")


def json_documents(spark: SparkSession, paths: str | list[str], records: str | None = None, text_fields: list[str] | None = None, all_strings: bool = False, lines: bool = False) -> DataFrame:
    """A document for each record; its text is that of text_fields, of all strings, of a usual field, or the record as JSON. Short scalar fields are its metadata. With lines=True each line that isn't blank is a record."""
    rows = spark.read.text(paths).where(F.trim("value") != "").select(F.parse_json("value").alias("record")) if lines else formats.read_json_records(spark, paths, records)
    text = F.array_join(formats.strings_udf()(F.to_json("record")), " ") if all_strings else formats.record_text("record", text_fields)
    fields = F.try_variant_get("record", "$", "map<string,variant>")
    scalars = F.map_filter(F.transform_values(fields, lambda _, v: F.try_variant_get(v, "$", "string")), lambda _, v: v.isNotNull() & (F.length(v) < 200))
    return rows.select(formats.value_at("record", "id").alias("id"), text.alias("text"), F.lit(None).cast("string").alias("source"), F.coalesce(scalars, F.create_map().cast("map<string,string>")).alias("metadata"))


def html_documents(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """A document for each page: its title is the source of its id, its meta elements are the metadata."""
    pages = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("html"))
    title = html.html_title(F.col("html"))
    metadata = F.map_concat(F.map_filter(html.html_meta(F.col("html")), lambda k, _: k != "title"), F.when(title.isNotNull(), F.create_map(F.lit("title"), title)).otherwise(F.create_map().cast("map<string,string>")))
    return pages.select(F.coalesce(html.slug(title), "source").alias("id"), html.html_text(F.col("html")).alias("text"), "source", metadata.alias("metadata"))


LOADERS: dict[str, Loader] = {"text": text_documents, "csv": csv_documents, "json": json_documents, "html": html_documents}


def detected(spark: SparkSession, path: str) -> str:
    """The loader of a path: by its ending, else by the first lines of its files."""
    ending = path.rsplit(".", 1)[-1].lower()
    if ending in ("csv", "tsv", "json", "html", "htm", "txt", "md"):
        return {"tsv": "csv", "htm": "html", "txt": "text", "md": "text"}.get(ending, ending)
    head = "\n".join(r.value for r in spark.read.text(path).limit(5).collect()).lstrip()  # five lines
    if head[:1] in ("{", "["):
        return "json"
    if head[:1] == "<":
        return "html"
    return "csv" if formats.detect_format(head) == "csv" else "text"


def load(spark: SparkSession, paths: str | list[str], loader: str | Loader | None = None, **options) -> DataFrame:
    """(id, text, source, metadata) of files: by a loader of one's own, by one of LOADERS, or by what the first path looks like."""
    if callable(loader):
        return loader(spark, paths, **options)
    name = loader or detected(spark, paths if isinstance(paths, str) else paths[0])
    if name not in LOADERS:
        raise ValueError(f"loader must be one of {sorted(LOADERS)}")
    return LOADERS[name](spark, paths, **options)


def load_all(spark: SparkSession, sources: list[tuple[str, str | Loader | None]]) -> DataFrame:
    """Documents of several (path, loader) pairs, one after the other."""
    return reduce(DataFrame.unionByName, [load(spark, path, loader) for path, loader in sources])
