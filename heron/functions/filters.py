"""Metadata filters: a dict of conditions compiled to one Column, so that Catalyst can push it to the scan."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPERATORS = ("$in", "$nin", "$gt", "$gte", "$lt", "$lte", "$ne", "$exists")
_NUMERIC = r"^(TINYINT|SMALLINT|INT|BIGINT|FLOAT|DOUBLE|DECIMAL.*)$"


class Field:
    """How a filter key is read: as one of a few types, and whether it is there or an explicit null."""

    def __init__(self, read: Callable[[str], Column], numeric: Column, present: Column, null: Column, text: Column):
        self.read, self.numeric, self.present, self.null, self.text = read, numeric, present, null, text


def column_field(df: DataFrame, prefix: str = "") -> Callable[[str], Field]:
    """Keys are typed columns (or fields below `prefix`). A typed column can't tell a missing key from a null one: both are null."""
    kinds = dict(df.dtypes)

    def field(key: str) -> Field:
        name = f"{prefix}.{key}" if prefix else key
        c = F.col(name)
        kind = kinds.get(name) or df.select(c).dtypes[0][1]
        number = kind.startswith(("tinyint", "smallint", "int", "bigint", "float", "double", "decimal"))
        return Field(lambda to: c.cast(to), F.lit(number) & c.isNotNull(), c.isNotNull(), c.isNull(), F.to_json(F.struct(c.alias("v"))))

    return field


def variant_field(column: str) -> Callable[[str], Field]:
    """Keys are paths of a VARIANT column, where a missing key and an explicit null differ."""

    def field(key: str) -> Field:
        path = "$." + key
        v = F.try_variant_get(F.col(column), path, "variant")
        return Field(
            lambda to: F.try_variant_get(F.col(column), path, to),
            F.coalesce(F.regexp_like(F.schema_of_variant(v), F.lit(_NUMERIC)), F.lit(False)),
            v.isNotNull(), F.coalesce(F.is_variant_null(v), F.lit(False)), F.concat(F.lit('{"v":'), F.to_json(v), F.lit("}")),
        )

    return field


def _equal(f: Field, x: Any) -> Column:
    """Equality without coercion: a number equals only numbers, a string only strings."""
    if x is None:
        return f.null
    if isinstance(x, bool):
        return F.coalesce(f.read("boolean") == F.lit(x), F.lit(False)) & ~f.numeric
    if isinstance(x, (int, float)):
        return F.coalesce(f.numeric & (f.read("double") == F.lit(float(x))), F.lit(False))
    if isinstance(x, (list, dict)):
        return F.coalesce(f.text == F.lit(json.dumps({"v": x}, separators=(",", ":"), ensure_ascii=False)), F.lit(False))
    return F.coalesce(f.read("string") == F.lit(x), F.lit(False)) & ~f.numeric


def _compare(f: Field, x: Any, test: Callable[[Column, Column], Column]) -> Column:
    """Only for numbers that aren't NaN, which Spark would put above all others."""
    v = f.read("double")
    return F.coalesce(f.numeric & ~F.isnan(v) & test(v, F.lit(float(x))), F.lit(False))


def condition(f: Field, wanted: Any, first_only: bool = False) -> Column:
    """One key's condition: a scalar, null, list, plain object, or an object of $operators, all of which must hold.

    With first_only, the first operator in the order of OPERATORS decides alone.
    """
    if not (isinstance(wanted, dict) and any(k.startswith("$") for k in wanted)):
        return _equal(f, wanted)
    if unknown := [k for k in wanted if k not in OPERATORS]:
        raise ValueError(f"unknown filter operators: {unknown}")
    tests = {
        "$in": lambda x: reduce(lambda a, b: a | b, [_equal(f, v) for v in x], F.lit(False)),
        "$nin": lambda x: ~reduce(lambda a, b: a | b, [_equal(f, v) for v in x], F.lit(False)),
        "$gt": lambda x: _compare(f, x, lambda v, y: v > y),
        "$gte": lambda x: _compare(f, x, lambda v, y: v >= y),
        "$lt": lambda x: _compare(f, x, lambda v, y: v < y),
        "$lte": lambda x: _compare(f, x, lambda v, y: v <= y),
        "$ne": lambda x: ~_equal(f, x),
        "$exists": lambda x: f.present if x else ~f.present,
    }
    found = [tests[k](wanted[k]) for k in OPERATORS if k in wanted]
    return found[0] if first_only else reduce(lambda a, b: a & b, found)


def matches(wanted: dict[str, Any], field: Callable[[str], Field], metadata: Column | None = None, first_only: bool = False) -> Column:
    """All keys' conditions. No condition matches every row; a row without any metadata (null) matches only that."""
    if not wanted:
        return F.lit(True)
    every = reduce(lambda a, b: a & b, [condition(field(k), v, first_only) for k, v in wanted.items()])
    return every if metadata is None else metadata.isNotNull() & every


def apply_filter(df: DataFrame, wanted: dict[str, Any], metadata: str | None = None, first_only: bool = False) -> DataFrame:
    """Rows of df that match; `metadata` names a VARIANT or struct column, without it keys are columns of df."""
    if metadata is None:
        return df.where(matches(wanted, column_field(df), None, first_only))
    field = variant_field(metadata) if dict(df.dtypes)[metadata] == "variant" else column_field(df, metadata)
    return df.where(matches(wanted, field, F.col(metadata), first_only))


def text_field(metadata: str, keys: tuple[str, ...] = ("_text", "text", "content", "body", "__text", "pageContent")) -> Column:
    """The first of the usual text keys of a VARIANT that holds a string."""
    return F.coalesce(*[F.when(F.schema_of_variant(F.try_variant_get(metadata, f"$.{k}", "variant")) == "STRING", F.try_variant_get(metadata, f"$.{k}", "string")) for k in keys])


def valid_document(id_col: str, vector_col: str, metadata_col: str | None = None, text_col: str | None = None, dimensions: int | None = None, most_metadata: int = 1 << 20, most_text: int = 100 * 1024) -> Column:
    """Why a document is invalid, as an array of reasons; empty if it is fine."""
    v = F.col(vector_col)
    checks = [(F.col(id_col).isNull() | (F.trim(F.col(id_col).cast("string")) == ""), "id is empty"), (F.coalesce(F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False)), "vector is not finite")]
    if dimensions is not None:
        checks.append((v.isNotNull() & (F.size(v) != dimensions), "dimensions differ"))
    if metadata_col:
        checks.append((F.octet_length(F.to_json(metadata_col)) > most_metadata, "metadata is too large"))
    if text_col:
        checks.append((F.octet_length(text_col) > most_text, "text is too large"))
    return F.filter(F.array(*[F.when(c, F.lit(why)) for c, why in checks]), lambda x: x.isNotNull())
