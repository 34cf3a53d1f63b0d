"""Line dedup by a segment-partition edit join: lines within a few edits of each other form a class, whose first occurrence stays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.llm.common import components, forest, group_links, saved, small_batches, small_side, table

#: Edits up to which two lines are one: one for each CHARS characters of the shorter line, EDITS at most.
EDITS, CHARS = 2, 12
#: Lines of a block of a signature; characters that a segment has at least when a large signature is dealt anew.
BLOCK, LEAST_SEGMENT = 256, 3
HISTOGRAM = 32


def allowed(length: int, edits: int = EDITS, chars: int = CHARS) -> int:
    """Edits by which a line may differ from one of this length or more; lines under `chars` characters must be equal."""
    return min(edits, length // chars)


def segments(length: int, edits: int) -> list[tuple[int, int]]:
    """Start and size of the edits + 1 segments of a line, even to one character."""
    base, more = divmod(length, edits + 1)
    sizes = [base + (i > edits - more) for i in range(edits + 1)]
    return [(sum(sizes[:i]), n) for i, n in enumerate(sizes)]


def probes(length: int, edits: int, shortest: int) -> list[tuple[int, int, int, int]]:
    """(indexed length, segment, start, size) of the substrings that a line must look up among lines as long or shorter.

    Of a pair within `edits`, some segment of the shorter line is a substring of the longer one whose start lies within
    the edits that can stand before it (from the left end) and after it (from the right end).
    """
    out = []
    for short in range(max(shortest, length - edits), length + 1):
        d = length - short
        for i, (p, n) in enumerate(segments(short, edits)):
            low, high = max(0, p - i, p + d - (edits - i)), min(length - n, p + i, p + d + (edits - i))
            out += [(short, i, start, n) for start in range(low, high + 1)]
    return out


def within(a: str, b: str, edits: int) -> bool:
    """Whether the edit distance of a and b is at most `edits`: bit-parallel columns in a band of 2 * edits + 1 diagonals.

    After Hyyro (2003). Equal ends are cut off first. A column's differences are the bits of a word as wide as the band,
    which slides down a row with each column, so the work grows with the length only; the score follows the lowest
    diagonal of the band, then the last row.
    """
    if abs(len(a) - len(b)) > edits:
        return False
    n = min(len(a), len(b))
    i = _equal_start(a, b, n)
    k = _equal_start(a[i:][::-1], b[i:][::-1], n - i)
    a, b = a[i : len(a) - k], b[i : len(b) - k]
    if not a or not b:
        return max(len(a), len(b)) <= edits
    if len(a) < len(b):
        a, b = b, a
    most, m = min(edits, len(a)), len(a)
    width = 2 * most + 2
    full, last, level, score = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2), most
    up, down = full & ~((1 << (width - most - 1)) - 1), 0
    for j, c in enumerate(b):
        at = most + 1 - width + j  # the row of bit 0
        match = 0
        for r in range(max(0, at), min(m, at + width)):
            if a[r] == c:
                match |= 1 << (r - at)
        diagonal = ((((match & up) + up) & full) ^ up) | match | down
        right_up, right_down = down | full & ~(diagonal | up), diagonal & up
        if j < m - most:  # the band's lowest diagonal runs down to the last row
            score += not diagonal & last
            if score > edits + most:  # it can't come back
                return False
        else:  # which is then followed to its end
            score += bool(right_up & level) - bool(right_down & level)
            level >>= 1
        shifted = diagonal >> 1
        up, down = right_down | full & ~(shifted | right_up), shifted & right_up
    return score <= edits


def _equal_start(a: str, b: str, n: int) -> int:
    """How many of the first n characters are equal, by halving."""
    low, high = 0, n
    while low < high:
        middle = (low + high + 1) // 2
        if a[low:middle] == b[low:middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _lines(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text_hash, at, line: the lines of each document; null has none."""
    text = F.col(text_col).cast("string")
    return (
        docs.select(F.col(id_col).alias("id"), text.alias("text")).select("id", F.xxhash64("text").alias("text_hash"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    )


def plan(length: int, edits: int, chars: int) -> list[tuple[int, int, int, int, bool]]:
    """(indexed length, segment, start, size, own) of the substrings that a line signs; own ones are its segments, by which it is found.

    Lines of each length are cut for the edits that this length allows, so a longer line looks them up by those.
    """
    own = {(length, i, p, size) for i, (p, size) in enumerate(segments(length, allowed(length, edits, chars)))}
    found = set(own)
    for short in range(max(chars, length - edits), length + 1):
        if length - short <= (k := allowed(short, edits, chars)):
            found.update(x for x in probes(length, k, short) if x[0] == short)
    return [(*x, x in own) for x in sorted(found)]


def rest_plan(length: int, edits: int, short: int) -> list[tuple[int, int, int, int, bool]]:
    """As `plan`, of what is left of a line, for rests of the length `short`, which are cut for `edits`."""
    own = {(length, i, p, size) for i, (p, size) in enumerate(segments(length, edits))} if length == short else set()
    return [(*x, x in own) for x in sorted(own | {x for x in probes(length, edits, max(1, short)) if x[0] == short})]


def line_signatures(docs: DataFrame, text_col: str, edits: int, chars: int) -> DataFrame:
    """(group, line, own) for each segment that a line of `chars` characters or more indexes and each substring it probes; group is the signature, line a 64-bit hash."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest, xxh64_intdigest

        plans: dict[int, tuple[list[tuple[int, int, int]], list[bool]]] = {}
        seen: set[int] = set()
        for batch in batches:
            signatures, lines, counts, owns = [], [], [], []
            for text in batch.column(0).to_pylist():
                for line in (text or "").split("\n"):
                    n = len(line)
                    if n < chars:
                        continue
                    key = xxh64_intdigest(line.encode(), 42)
                    if key in seen:
                        continue
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(key)
                    if (known := plans.get(n)) is None:
                        found = plan(n, edits, chars)
                        known = plans[n] = [(length * (edits + 1) + i, 4 * p, 4 * (p + size)) for length, i, p, size, _ in found], [x[4] for x in found]
                        if len(plans) > 5_000:
                            plans.clear()
                    wide = line.encode("utf-32-le")
                    signatures += [xxh3_64_intdigest(wide[a:b], seed) for seed, a, b in known[0]]
                    owns += known[1]
                    lines.append(key), counts.append(len(known[1]))
            if lines:
                repeated = np.repeat(np.array(lines, np.uint64).view(np.int64), counts)
                yield pa.RecordBatch.from_arrays([pa.array(np.array(signatures, np.uint64).view(np.int64)), pa.array(repeated), pa.array(owns, pa.bool_())], names=["group", "line", "own"])

    return docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(run, "group long, line long, own boolean")


def shared(rows: DataFrame, line: str) -> DataFrame:
    """Rows of the groups that two lines or more have, one of which is found by it.

    Groups are counted with partial sums, so a frequent one costs no task; rows are read twice and joined to those groups.
    """
    live = rows.groupBy("group").agg(F.min(line).alias("a"), F.max(line).alias("b"), F.max("own").alias("own")).where("own AND a != b").select("group")
    return rows.join(small_side(saved(live)), "group", "left_semi")


def dealt_anew(rows: DataFrame, edits: int, chars: int) -> tuple[DataFrame, DataFrame]:
    """Groups of lines that share a segment, dealt by the segments of what is left of the lines without it; first come the groups whose rests are too short for that.

    The edits of a pair that meets in a group stand before and behind the shared segment, so the rests of both are
    within the same edits of each other, those that the indexed line of the group allows, and share a segment again.
    """
    names = ["group", "node", "text", "rest", "short", "most", "own", "seed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest

        def signed(rest: str, salt: int, short: int | None, most: int | None) -> Iterator[tuple[int, int, int, int, int, bool]]:
            wide = rest.encode("utf-32-le")
            for length, i, p, size, own in plan(len(rest), edits, chars) if short is None else rest_plan(len(rest), most, short):
                key = xxh3_64_intdigest(wide[4 * p : 4 * (p + size)], (length * (edits + 1) + i) ^ (salt & (1 << 64) - 1))
                yield key - (key >> 63 << 64), length, allowed(length, edits, chars) if most is None else most, p, size, own

        for batch in batches:
            out: list[tuple] = []
            for group, node, text, rest, short, most, own, salt in zip(*(c.to_pylist() for c in batch.columns)):
                for key, length, edits_here, p, size, indexed in signed(rest, salt, short, most):
                    if key == group:  # the substring that led here
                        left = rest[:p] + rest[p + size :]
                        out += [(k, node, text, left, length - size, edits_here, own and indexed and mine, group) for k, *_, mine in signed(left, group, length - size, edits_here)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), types)] if out else [pa.array([], t) for t in types], names=names)

    types = [pa.int64(), pa.binary(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.int64()]
    least = LEAST_SEGMENT * (edits + 1)
    long = saved(rows.groupBy("group").agg(F.min(F.length("rest")).alias("least")).where(F.col("least") >= least).select("group"))
    anew = rows.join(small_side(long), "group", "left_semi").select(*names).mapInArrow(run, "group long, node binary, text string, rest string, short int, most int, own boolean, seed long")
    once = shared(anew, "node").groupBy("group", "node", "text", "rest", "short", "most", "seed").agg(F.max("own").alias("own"))
    return rows.join(small_side(long), "group", "left_anti"), once


def edit_links(rows: DataFrame, edits: int, chars: int) -> DataFrame:
    """(u, v), in line keys, that join the lines (group, node, text, ...) of a group that are within the edits that the shorter one allows."""

    def verify(columns: list[list], in_a: np.ndarray, in_b: np.ndarray, classes: np.ndarray) -> list[tuple[int, int]]:
        lines, own = columns[0], np.array(columns[1])
        most = [allowed(len(x), edits, chars) for x in lines]
        if len(lines) == 2:
            return [(0, 1)] if within(lines[0], lines[1], min(most)) else []
        sizes = np.array([len(x) for x in lines])
        counts = np.stack([np.bincount(np.frombuffer(x.encode("utf-32-le"), np.uint32) % HISTOGRAM, minlength=HISTOGRAM) for x in lines]).astype(np.int32)

        def near(a: int) -> np.ndarray:
            return (own | own[a]) & (np.abs(sizes - sizes[a]) <= edits) & (np.abs(counts - counts[a]).sum(axis=1) <= 2 * edits)

        return forest(in_a, in_b, classes, near, lambda a, b: within(lines[a], lines[b], min(most[a], most[b])))

    return group_links(rows, ["text", "own", "rest", "short", "most", "seed"], verify, BLOCK, weight=F.length("text"), split=lambda x: dealt_anew(x, edits, chars))


def line_classes(docs: DataFrame, text_col: str, edits: int, chars: int) -> DataFrame:
    """(node, component): keys (MD5) of lines that are within the allowed edits of some other line, and their class, closed over chains.

    Only lines that share a signature with another one get their text back, and only pairs of one signature are verified.
    """
    meets = saved(shared(line_signatures(docs, text_col, edits, chars), "line").groupBy("group", "line").agg(F.max("own").alias("own")))
    lines = docs.select(F.explode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("text")).where(F.length("text") >= chars)
    texts = lines.withColumn("line", F.xxhash64("text")).join(small_side(saved(meets.select("line").distinct())), "line", "left_semi").distinct()
    members = meets.join(texts, "line").select("group", F.unhex(F.md5("text")).alias("node"), "text", "own", F.col("text").alias("rest"), F.lit(None).cast("int").alias("short"), F.lit(None).cast("int").alias("most"), F.lit(0).cast("long").alias("seed"))
    return components(edit_links(saved(members), edits, chars))


def line_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """A row for each line: id, text_hash, at (from 0), class_id, class_at (the first occurrence of its class by id and place), n_class, kept.

    A class holds the lines that are joined by chains of pairs of a small edit distance: one edit for each `chars` code
    points of the shorter line, `edits` at most, so lines under `chars` are matched by equality. Its first occurrence is
    kept, every other one is a duplicate. Empty lines have no text to repeat: they are kept, classes of their own.
    Lines end at \\n and are compared as they are; the search is exact: any such pair shares a segment, and every pair
    found is verified.

    A null text has no lines, an empty one has one empty line. Rows that repeat both id and text count as the same
    place, so that all of them keep or lose the same lines. Null ids come first; ids are of any type with an order. A
    very long line takes about 200 bytes of memory for each of its characters while it is signed. An empty table gives
    no rows. Other columns, whatever their names, are ignored.
    """
    classes = line_classes(docs, text_col, edits, max(1, chars))
    places = _lines(docs, id_col, text_col)
    long = places.where("line != ''").select("id", "text_hash", "at", F.unhex(F.md5("line")).alias("key"))
    distinct = long.groupBy("key").agg(F.min(F.struct("id", "text_hash", "at")).alias("first"), F.count("*").alias("n"))
    classed = distinct.join(classes, F.col("key") == F.col("node"), "left").select("key", "first", "n", F.coalesce("component", "key").alias("class"))
    firsts = classed.groupBy("class").agg(F.min("first").alias("first"), F.sum("n").alias("n_class")).where("n_class > 1")
    known = classed.select("key", "class").join(firsts, "class").select("key", F.col("first.id").alias("class_id"), F.col("first.text_hash").alias("class_hash"), F.col("first.at").alias("class_at"), "n_class")
    # A line that is no member of a class gets a key of eight bytes, which matches none of sixteen, so that such lines are spread over all tasks.
    key = F.when(F.col("line") != "", F.unhex(F.md5("line"))).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("id", "text_hash", "at")), 16, "0")))
    found = places.select("id", "text_hash", "at", key.alias("key")).join(known, "key", "left")
    single = F.col("n_class").isNull()
    same = F.col("id").eqNullSafe(F.col("class_id")) & (F.col("text_hash") == F.col("class_hash")) & (F.col("at") == F.col("class_at"))
    return found.select(
        "id", "text_hash", "at",
        F.when(single, F.col("id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(single, F.col("at")).otherwise(F.col("class_at")).alias("class_at"),
        F.coalesce("n_class", F.lit(1)).alias("n_class"),
        (single | same).alias("kept"),
    )


@F.pandas_udf(T.StringType())
def _without(text, gone):
    """text without the lines at the places in gone; null stays null."""
    drop = [None if g is None else set(g) for g in gone]
    return text.__class__([None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in d) for t, d in zip(text, drop)], dtype=object)


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS, chars: int = CHARS) -> DataFrame:
    """docs with duplicate lines taken out of the text; a document that loses every line goes, one without lines stays.

    Empty lines stay. The columns, of any names, are those of docs; where n_chars is among
    them, it is set to the new length of a changed text. Nulls, repeated rows and empty tables: see line_duplicates.
    """
    marks = line_duplicates(docs, id_col, text_col, edits, chars)
    gone = marks.where(~F.col("kept")).groupBy("id", "text_hash").agg(F.collect_set("at").alias("gone"))
    text = F.col(text_col).cast("string")
    here = docs.select(F.struct("*").alias("doc"), F.col(id_col).alias("id"), F.xxhash64(text).alias("text_hash"))
    joined = here.alias("a").join(gone.alias("b"), F.col("a.id").eqNullSafe(F.col("b.id")) & (F.col("a.text_hash") == F.col("b.text_hash")), "left").select("doc", "gone")
    text, cut = F.col("doc").getField(text_col).cast("string"), F.col("gone").isNotNull()
    joined = joined.where(~cut | (F.size("gone") < F.size(F.split(text, "\n", -1)))).withColumn("new", _without(F.when(cut, text), F.col("gone")))
    changed = F.col("doc").withField(text_col, F.coalesce("new", text))
    if "n_chars" in docs.columns:
        changed = changed.withField("n_chars", F.when(cut, F.length("new").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("doc.n_chars")))
    return joined.select(changed.alias("doc")).select("doc.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = line_duplicates(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("at").cast("long").alias("line"), F.col("class_id").alias("class_doc"), F.col("class_at").cast("long").alias("class_line"), "n_class", "kept")
