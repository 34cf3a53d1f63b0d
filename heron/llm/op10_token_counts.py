"""Token counts of sections by offset-mapped attribution: a document is encoded once and its tokens are joined to sections by their spans."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heron.llm.common import small_batches, table, with_fields
from heron.llm.tokens import encoder, public_path

RULES = ("start", "end", "majority")


def attribute(starts: np.ndarray, ends: np.ndarray, edges: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token and whether it crosses an edge. Sections are [edges[i], edges[i + 1]).

    start: where the token begins; end: where its last byte lies; majority: where most of its bytes lie, the earlier
    section if none has more. Sorted spans meet sorted edges in one binary search for each token, the interval join.
    """
    first, last = np.searchsorted(edges, starts, "right") - 1, np.searchsorted(edges, ends - 1, "right") - 1
    crossing = first != last
    at = {"start": first, "end": last}.get(rule)
    if at is None:
        at = first.copy()
        for t in np.flatnonzero(crossing).tolist():
            cuts = np.concatenate([[starts[t]], edges[first[t] + 1 : last[t] + 1], [ends[t]]])
            at[t] = first[t] + int(np.argmax(np.diff(cuts)))
    return at, crossing


def token_counts(docs: DataFrame, id_col: str = "doc_id", fields: tuple[str, ...] = ("text",), lines: bool = True, rule: str = "start", path: str | None = None) -> DataFrame:
    """A row for each section of a document: (id, field, section, char_start, char_end, n_tokens, n_crossing).

    The fields of a document are joined by \\n (which belongs to the field before it) and encoded once, whole, without
    special tokens. A section is a line of a field with its \\n, or with lines=False the field. Each token is counted
    in exactly one section, chosen by `rule` (see attribute), so a document's counts add up to its tokens; n_crossing
    counts those that reach into a later section. Spans are in code points of the joined text.

    Null fields are empty; an empty field is one section without tokens, so every row of docs gives rows. Rows that
    repeat an id are counted each. A very long text is encoded whole, in one task. An empty table gives no rows. Other
    columns are ignored.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    path = path or public_path()
    small_batches(docs.sparkSession)
    names = ["id", "field", "section", "char_start", "char_end", "n_tokens", "n_crossing"]
    schema = with_fields(docs.select(F.col(id_col).alias("id")), "field string, " + ", ".join(f"{name} long" for name in names[2:]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        widths = coder.widths()
        for batch in batches:
            records = list(zip(*([x or "" for x in c.to_pylist()] for c in batch.columns[1:])))
            texts = ["\n".join(r) for r in records]
            owners, field_of, sections, char_start, char_end, counts, crossings = [], [], [], [], [], [], []
            for row, (record, text, ids) in enumerate(zip(records, texts, coder.encode(texts))):
                data = text.encode()
                raw = np.frombuffer(data, np.uint8)
                edges, of = [], []
                at = 0
                for f, value in enumerate(record):
                    size = len(value.encode())
                    own = [at]
                    if lines:
                        own += (np.flatnonzero(raw[at : at + size] == 10) + at + 1).tolist()
                    edges += own
                    of += [f] * len(own)
                    at += size + 1
                edges, n = np.array(edges), len(edges)
                ends = np.cumsum(widths[np.frombuffer(ids, coder.dtype)])
                starts = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                section, crossing = attribute(starts, ends, edges, rule)
                stops = np.append(edges[1:], len(data))
                if len(data) == len(text):
                    a, b = edges, stops
                else:
                    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
                    a, b = chars[edges], chars[stops]
                owners += [row] * n
                field_of += of
                sections.append(np.arange(n) - np.searchsorted(np.array(of), np.array(of)))
                char_start.append(a), char_end.append(b)
                counts.append(np.bincount(section, minlength=n)), crossings.append(np.bincount(section[crossing], minlength=n))
            if not owners:
                continue
            numbers = [pa.array(np.concatenate(x).astype(np.int64)) for x in (sections, char_start, char_end, counts, crossings)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owners)), pa.array([fields[f] for f in field_of], pa.string()), *numbers], names=names)

    columns = [F.col(c).cast("string").alias(f"field_{i}") for i, c in enumerate(fields)]
    return docs.select(F.col(id_col).alias("id"), *columns).mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    """Tokens of every line of every document."""
    return token_counts(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id").drop("field")
