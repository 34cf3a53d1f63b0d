"""Collections of documents as tables keyed by (collection_id, id): upsert, update, delete, export and import."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heron.functions import privacy

KEY = ["collection_id", "id"]


def upserted(table: DataFrame, changes: DataFrame, order: str | None = None) -> DataFrame:
    """table with changes (the same columns) in place of rows with the same key; created_at, if there, stays that of the first row.

    Of repeated keys in changes the last by `order` counts; without an order, the greatest row, so that the result
    does not hang on the partitioning.
    """
    rest = F.struct(*[F.col(c) for c in table.columns if c not in KEY])
    last = changes.groupBy(*KEY).agg(F.max_by(rest, F.col(order)).alias("x") if order else F.max_by(rest, F.struct(F.xxhash64(F.to_json(rest)), F.to_json(rest))).alias("x")).select(*KEY, "x.*")
    if "created_at" in table.columns:
        old = table.select(*KEY, F.col("created_at").alias("__old"))
        last = last.join(old, KEY, "left").withColumn("created_at", F.coalesce("__old", "created_at")).drop("__old")
    return table.join(last.select(*KEY), KEY, "left_anti").unionByName(last.select(*table.columns))


def updated(table: DataFrame, changes: DataFrame, set_nulls: bool = False) -> DataFrame:
    """table with the columns of changes (KEY and some others) where these are not null, or with set_nulls wherever a key has changes; keys that table doesn't have are ignored."""
    new = changes.select(*KEY, F.struct(*[c for c in changes.columns if c not in KEY]).alias("__new"))
    joined = table.join(new, KEY, "left")
    value = lambda c: F.when(F.col("__new").isNotNull(), F.col(f"__new.{c}")).otherwise(F.col(c)) if set_nulls else F.coalesce(f"__new.{c}", c)
    return joined.select(*[value(c).alias(c) if c in changes.columns and c not in KEY else F.col(c) for c in table.columns])


def deleted(table: DataFrame, keys: DataFrame) -> DataFrame:
    return table.join(keys.select(*KEY), KEY, "left_anti")


def deleted_where(table: DataFrame, condition: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row with the number of rows that go. A condition that is null keeps the row."""
    goes = F.coalesce(condition, F.lit(False))
    return table.where(~goes), table.where(goes).agg(F.count("*").alias("deleted"))


def cleared(table: DataFrame, collection: str) -> DataFrame:
    return table.where(F.col("collection_id") != collection)


def stats(table: DataFrame) -> DataFrame:
    """(collection_id, n, vector_bytes)."""
    return table.groupBy("collection_id").agg(F.count("*").alias("n"), (F.sum(F.size("vector")) * 4).alias("vector_bytes"))


def export(table: DataFrame, path: str, collections: list[str] | None = None, with_vectors: bool = True) -> None:
    """JSON lines, a folder for each collection."""
    rows = table if collections is None else table.where(F.col("collection_id").isin(collections))
    (rows if with_vectors else rows.drop("vector")).write.partitionBy("collection_id").mode("overwrite").json(path)


def imported(table: DataFrame, path: str, mode: str = "merge") -> DataFrame:
    """The table after an import of an export: merge upserts, replace drops the collections that come; rows without a vector are left out."""
    if mode not in ("merge", "replace"):
        raise ValueError("mode must be merge or replace")
    rows = table.sparkSession.read.schema(table.schema).json(path).where("vector IS NOT NULL").select(*table.columns)
    if mode == "merge":
        return upserted(table, rows)
    return table.join(rows.select("collection_id").distinct(), "collection_id", "left_anti").unionByName(rows)


def write(table: DataFrame, path: str) -> None:
    """Parquet by collection, so that a scan of one collection reads only its folder."""
    table.write.partitionBy("collection_id").mode("overwrite").parquet(path)


def transformed(table: DataFrame, **columns: Column | None) -> DataFrame:
    """table with columns computed anew, or dropped where None is given."""
    gone = [c for c, v in columns.items() if v is None]
    return table.withColumns({c: v for c, v in columns.items() if v is not None}).drop(*gone)


def copied(table: DataFrame, source: str, target: str, condition: Column | None = None) -> DataFrame:
    """table with the rows of one collection (those that meet the condition) copied to another, whose rows with the same ids they replace."""
    rows = table.where(F.col("collection_id") == source)
    rows = (rows if condition is None else rows.where(condition)).withColumn("collection_id", F.lit(target))
    return upserted(table, rows)


def renamed(table: DataFrame, source: str, target: str) -> DataFrame:
    return table.withColumn("collection_id", F.when(F.col("collection_id") == source, target).otherwise(F.col("collection_id")))


#: A step of a schema: the version it makes, and what it does to a table.
Migration = tuple[int, Callable[[DataFrame], DataFrame]]


def migrated(table: DataFrame, version: int, migrations: list[Migration], target: int | None = None) -> tuple[DataFrame, int]:
    """table and its version after the steps above `version` (up to `target`), in the order of their versions; one plan, however many steps."""
    for made, step in sorted(migrations, key=lambda m: m[0]):
        if made > version and (target is None or made <= target):
            table, version = step(table), made
    return table, version


def hooked(table: DataFrame, action: Callable[..., DataFrame], *arguments, before: tuple[Callable[[DataFrame], DataFrame], ...] = (), after: tuple[Callable[[DataFrame], DataFrame], ...] = ()) -> DataFrame:
    """An action on a table (upserted, deleted, a search, ...) between hooks: `before` ones see its first argument, `after` ones its result, each in turn."""
    first, *others = arguments or (None,)
    for hook in before:
        first = hook(first)
    out = action(table, *([first] if arguments else []), *others)
    for hook in after:
        out = hook(out)
    return out


def encrypted(rows: DataFrame, key: bytes, columns: list[str]) -> DataFrame:
    """rows with the columns (strings, or anything as JSON) encrypted; other columns stay readable for filters."""
    kinds = dict(rows.dtypes)
    return rows.withColumns({c: privacy.encrypt(F.col(c) if kinds[c] == "string" else F.to_json(F.struct(F.col(c).alias("v"))), key) for c in columns})


def decrypted(rows: DataFrame, key: bytes, columns: dict[str, str]) -> DataFrame:
    """encrypted() undone: columns and their types as DDL."""
    plain = {c: privacy.decrypt(F.col(c), key) for c in columns}
    return rows.withColumns({c: v if columns[c] == "string" else F.from_json(v, f"v {columns[c]}")["v"] for c, v in plain.items()})


def import_from(table: DataFrame, collection: str, records: DataFrame, dimensions: int, embedder: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """table (collection_id, id, vector, text) with records (id, vector, text) of another system, and one row: imported, skipped, re_embedded.

    Records with a vector of the right width go in as they are; those with only a text, or with a vector of another
    width and a text, are embedded if there is an embedder; the others, and those without id, are skipped.
    """
    fits = F.coalesce(F.size("vector") == dimensions, F.lit(False))
    how = F.when(F.col("id").isNull(), "skipped").when(fits, "imported").when(F.col("text").isNotNull() & F.lit(embedder is not None), "re_embedded").otherwise("skipped")
    judged = records.select("id", "vector", "text", how.alias("how"))
    kept = judged.where("how = 'imported'").select("id", F.col("vector").cast("array<float>").alias("vector"), "text")
    if embedder is not None:
        kept = kept.unionByName(judged.where("how = 're_embedded'").select("id", embedder(F.col("text")).alias("vector"), "text"))
    counts = judged.agg(*[F.count(F.when(F.col("how") == x, 1)).alias(x) for x in ("imported", "skipped", "re_embedded")])
    return upserted(table, kept.withColumn("collection_id", F.lit(collection)).select(*table.columns)), counts
