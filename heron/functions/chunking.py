"""Chunks of texts: fixed windows as SQL, structure-aware chunks as folds over the parts of a text, semantic groups as windows over segments."""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import chain, groupby, islice, pairwise, repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heron.functions import vectors as V

SIZE, OVERLAP, LEAST = 500, 50, 50
#: Separators from the coarsest to the finest; the empty one cuts anywhere.
SEPARATORS = ("\n\n\n", "\n\n", "\n", ". ", "? ", "! ", "; ", ", ", " ", "")
CHUNKS = "array<struct<at:int,text:string,start:int,end:int,kind:string,path:array<string>>>"


def windows(text: Column, size: int = SIZE, overlap: int = OVERLAP) -> Column:
    """Trimmed fixed windows as an array of (at, start, text); empty ones are left out."""
    step = max(1, size - overlap)
    n = F.length(text)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("start"), F.trim(F.substring(text, i + 1, F.lit(size))).alias("text")))
    return F.filter(cut, lambda c: F.length(c["text"]) > 0)


#: White space as Python's str.isspace has it, for regular expressions.
WHITE = r"[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
IMPORT = r"(import|from|#include|using|use|require|package)\b"


def split_behind(text: Column, separators: tuple[str, ...] = SEPARATORS, size: int = SIZE) -> Column:
    """array<string> of parts of at most `size` characters that together are the text, each cut behind the coarsest separator that serves."""
    parts = F.array(text)
    for s in separators:
        if s:
            cut = lambda p, s=s: F.filter(F.split(p, f"(?<={re.escape(s)})", -1), lambda x: x != "")
        else:
            cut = lambda p: F.regexp_extract_all(p, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
        parts = F.flatten(F.transform(parts, lambda p: F.when(F.length(p) <= size, F.array(p)).otherwise(cut(p))))  # noqa: B023
    return parts


# ---- texts that know where they come from ---------------------------------------------------------------------------


@dataclass
class Placed:
    """A text and, for each of its parts, (where it begins here, where it begins in the document)."""

    text: str
    parts: list[tuple[int, int]]

    def source(self, at: int) -> int:
        i = bisect_right(self.parts, at, key=lambda p: p[0]) - 1
        return self.parts[i][1] + at - self.parts[i][0]

    def between(self, start: int, end: int) -> Placed:
        if len(self.parts) == 1:
            ((a, b),) = self.parts
            return Placed(self.text[start:end], [(max(a - start, 0), b + max(start - a, 0))])
        first = max(bisect_right(self.parts, start, key=lambda p: p[0]) - 1, 0)
        last = max(bisect_left(self.parts, end, key=lambda p: p[0]), first + 1)
        return Placed(self.text[start:end], [(max(a - start, 0), b + max(start - a, 0)) for a, b in self.parts[first:last]])

    def stripped(self, of: str | None = None) -> Placed:
        left, right = len(self.text) - len(self.text.lstrip(of)), len(self.text.rstrip(of))
        return self if right - left == len(self.text) else self.between(left, max(right, left))

    def span(self) -> tuple[int, int]:
        """Where it begins and ends in the document, white space at its ends apart."""
        left, right = len(self.text) - len(self.text.lstrip()), len(self.text.rstrip())
        return (self.source(left), self.source(right - 1) + 1) if right > left else (self.source(0),) * 2


def joined(parts: list[Placed], by: str) -> Placed:
    places, at = [], 0
    for p in parts:
        if len(p.parts) == 1:
            ((a, b),) = p.parts
            places.append((at + a, b))
        else:
            places += [(at + a, b) for a, b in p.parts]
        at += len(p.text) + len(by)
    return Placed(by.join(p.text for p in parts), places)


#: A block or chunk: its text, its kind, and what stands above it.
Block = tuple[Placed, str, tuple[str, ...]]


# ---- folds: the parts of a document in, its chunks out; none holds more than the block at hand ------------------------


def tail(now: Placed, overlap: int) -> Placed:
    """The last `overlap` characters, from the next word on."""
    if len(now.text) <= overlap:
        return now
    cut = now.text.find(" ", len(now.text) - overlap)
    return now.between(cut + 1 if cut >= 0 else len(now.text) - overlap, len(now.text))


def merged(pieces: Iterable[Placed], size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Iterator[Placed]:
    """Greedy chunks of pieces, joined by blanks, each beginning with the tail of the one before; a short last one joins its neighbour. A lone piece stays as it is."""
    n, now, length, held = 0, [], 0, None  # now: parts of the open chunk, whose text with blanks between them has `length` characters
    for part in pieces:
        text = part.text.strip()
        if not text:
            continue
        n += 1
        if len(text) < len(part.text):
            left = len(part.text) - len(part.text.lstrip())
            part = part.between(left, left + len(text))
        if now and length + len(text) + 1 > size:
            if held is not None:
                yield _evened(held)
            held = joined(now, " ")
            rest = tail(held, overlap) if overlap else None
            now = [rest, part] if rest is not None and rest.text else [part]
            length = len(text) + (len(rest.text) + 1 if len(now) > 1 else 0)
        else:
            length += len(text) + (1 if now else 0)
            now.append(part)
    if not now:
        return
    last = joined(now, " ") if n > 1 else now[0]
    if held is None:
        yield last if n == 1 else _evened(last)
    elif length < least:
        yield _evened(joined([held, last], " "))
    else:
        yield _evened(held)
        yield _evened(last)


def _evened(chunk: Placed) -> Placed:
    """White space made single blanks; only its span is asked for from here on."""
    a, b = chunk.span()
    text = " ".join(chunk.text.split())
    return Placed(text, [(0, a), (len(text) - 1, b - 1)] if len(text) > 1 else [(0, a)])


def _cut(block: Placed, size: int) -> list[Placed]:
    """merged() without overlap of a block that is larger than `size`."""

    def parts(p: Placed, separators: tuple[str, ...]) -> Iterator[Placed]:
        if len(p.text) <= size or not separators:
            yield p
            return
        s = separators[0]
        ends = [m.end() for m in re.finditer(f"(?<={re.escape(s)})", p.text)] if s else list(range(size, len(p.text), size))
        for a, b in pairwise([0, *ends, len(p.text)]):
            if b > a:
                yield from parts(p.between(a, b), separators[1:])

    return list(merged(parts(block.stripped(), SEPARATORS), size, 0, 0))


def packed(blocks: Iterable[Block], size: int, least: int) -> Iterator[Block]:
    """Neighbouring blocks of one kind and path joined up to `size`; larger ones are cut. Chunks under `least` characters are dropped, by definition of these chunkers; least=0 keeps all."""
    now: list[Placed] = []
    held, key = 0, ("", ())
    for block, kind, path in chain(blocks, [(Placed("", [(0, 0)]), "end", ())]):
        whole = kind in ("fence", "table")
        if now and (key != (kind, path) or whole or held + len(block.text) > size):
            full = joined(now, "\n")
            for x in _cut(full, size) if len(full.text) > size and key[0] not in ("fence", "table") else [full]:
                if len(x.text) >= least:
                    yield x, *key
            now, held = [], 0
        key = (kind, path)
        if block.text:
            now.append(block)
            held += len(block.text)


def markdown_blocks(lines: Iterable[Placed]) -> Iterator[Block]:
    """Blocks of Markdown with their kind and the headers above them."""
    headers: list[tuple[int, str]] = []
    fence, rows = None, []
    for line in lines:
        text, path = line.text, tuple(t for _, t in headers)
        mark = re.match(r"\s*(```|~~~)", text)
        if fence:
            rows.append(line)
            if mark and mark[1] == fence:
                yield joined(rows, "\n"), "fence", path
                fence, rows = None, []
            continue
        kind = "fence" if mark else "table" if text.lstrip().startswith("|") else "header" if re.match(r"#{1,6} ", text) else "list" if re.match(r"\s*([-*+]|\d+[.)]) ", text) else "quote" if text.startswith(">") else "text" if text.strip() else "blank"
        if rows and kind != "table":
            yield joined(rows, "\n"), "table", path
            rows = []
        if kind == "fence":
            fence, rows = mark[1], [line]
        elif kind == "table":
            rows.append(line)
        elif kind == "header":
            level = len(text) - len(text.lstrip("#"))
            headers = [x for x in headers if x[0] < level] + [(level, text.lstrip("#").strip())]
        elif kind != "blank":
            yield line, kind, path
    if rows:
        yield joined(rows, "\n"), "fence" if fence else "table", tuple(t for _, t in headers)


#: What begins a definition, by language; rules of our own.
CODE = {
    "python": r"(?:async )?(?:def|class) |@", "javascript": r"(?:export )?(?:default )?(?:async )?(?:function|class|const \w+ = )", "typescript": r"(?:export )?(?:default )?(?:async )?(?:function|class|interface|type|enum) ",
    "java": r"(?:public|private|protected|class|interface|enum) ", "go": r"(?:func|type) ", "rust": r"(?:pub )?(?:fn|struct|enum|trait|impl|mod) ", "c": r"\w[\w\s*]+\(", "cpp": r"(?:class|struct|template|namespace) |\w[\w\s*:<>]+\(",
    "csharp": r"(?:public|private|internal|namespace|class) ", "ruby": r"(?:def|class|module) ", "php": r"(?:function|class|interface) ", "swift": r"(?:func|class|struct|enum|protocol|extension) ", "kotlin": r"(?:fun|class|object|interface) ",
}
#: Marks of languages in the order in which they decide. A rule holds if each of its parts has one of the marks given for it: `head` is the first 50 lines in lower case, `text` the whole text as it is.
_REACT, _JAVA = ("head", ("import react", 'from "react"')), ("head", ("public static void main", "package "))
LANGUAGES = (
    ("typescript", (_REACT, ("text", (": ",)), ("text", ("interface ", ": React.")))), ("javascript", (_REACT,)),
    ("go", (("head", ("package main", "func main()")),)), ("rust", (("head", ("fn main()", "impl ")),)), ("python", (("head", ("def __init__", "import numpy")),)),
    ("kotlin", (_JAVA, ("head", ("fun ", "val ")))), ("java", (_JAVA,)), ("csharp", (("head", ("namespace ", "using system")),)), ("cpp", (("head", ("#include <",)),)),
    ("php", (("head", ("<?php",)),)), ("swift", (("head", ("import foundation", "import uikit")),)), ("ruby", (("head", ("require ",)), ("head", ("end",)))),
    ("typescript", (("text", ("interface ", ": ")),)), ("javascript", (("text", ("function ", "=>")),)), ("python", (("text", ("def ", "class ")),)),
)


def code_language(text: Column) -> Column:
    """The programming language of a text by the first of LANGUAGES' rules that holds; generic if none does, null for null."""
    parts = {"head": F.lower(F.array_join(F.slice(F.split(text, "\n"), 1, 50), "\n")), "text": text}
    out = F.when(text.isNull(), F.lit(None).cast("string"))
    for name, rule in LANGUAGES:
        held = [reduce(lambda a, b: a | b, [parts[part].contains(m) for m in marks]) for part, marks in rule]
        out = out.when(reduce(lambda a, b: a & b, held), name)
    return out.otherwise("generic")


def code_blocks(lines: Iterable[Placed], language: str) -> Iterator[Block]:
    """Blocks of code: imports, definitions (from their first line to the next at the margin), and the rest."""
    begins, now, kind, name = re.compile(CODE[language]), [], "code", ()
    for line in chain(lines, [None]):
        imports, starts = (re.match(IMPORT, line.text), begins.match(line.text)) if line else (None, None)
        if line is None or (imports and kind != "import") or starts or (kind == "import" and not imports and line.text.strip()):
            if any(x.text.strip() for x in now):
                yield joined(now, "\n").stripped("\n"), kind, name
            now, kind = [], "import" if imports else "definition" if starts else "code"
            name = (line.text.strip()[:80],) if starts else ()
        if line is not None:
            now.append(line)


# ---- chunkers of tables ---------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Chunker:
    """parts: an expression that cuts a text into an array of strings, which in order are the text (but for `gap`
    characters between two); fold: a generator from the parts of one document to its blocks; head: an expression of the
    text that is put in front of chunks of kind `definition`."""

    parts: Callable[[Column], Column]
    fold: Callable[[Iterable[Placed]], Iterable[Block]]
    gap: int = 0
    head: Callable[[Column], Column] | None = None


def recursive_chunks(size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST) -> Chunker:
    return Chunker(lambda t: split_behind(t, SEPARATORS, size), lambda parts: ((x, "text", ()) for x in merged(parts, size, overlap, least)))


def markdown_chunks(size: int = SIZE, least: int = LEAST) -> Chunker:
    return Chunker(lambda t: F.split(t, "\n", -1), lambda lines: packed(markdown_blocks(lines), size, least), gap=1)


def chunker(strategy: str, **options) -> Chunker:
    """The chunker of a strategy: markdown, code (with language=), else recursive, which sentence, paragraph and semantic also mean."""
    made = {"markdown": markdown_chunks, "code": code_chunks, **dict.fromkeys(("recursive", "sentence", "paragraph", "semantic"), recursive_chunks)}
    if strategy not in made:
        raise ValueError(f"strategy must be one of {sorted(made)}")
    return made[strategy](**options)


def code_chunks(language: str, size: int = 1000, least: int = LEAST, with_imports: bool = False) -> Chunker:
    """Chunks of code; with_imports puts a text's lines of imports in front of each chunk of a definition (its place is that of the definition)."""
    imports = lambda t: F.array_join(F.filter(F.split(t, "\n", -1), lambda x: x.rlike("^" + IMPORT)), "\n")
    return Chunker(lambda t: F.split(t, "\n", -1), lambda lines: packed(code_blocks(lines, language), size, least), gap=1, head=imports if with_imports else None)


def _folded(batches: Iterator[pa.RecordBatch], how: Chunker) -> Iterator[pa.RecordBatch]:
    """Chunks of rows (id, lead, head, at, part), in which a document is a run that begins with at = 0."""
    kept: dict[str, pa.DataType] = {}

    def stream() -> Iterator[tuple]:
        for batch in batches:
            kept["id"] = batch.schema.field("id").type
            yield from zip(*(batch.column(i).to_pylist() if batch.column(i).null_count < batch.num_rows else repeat(None, batch.num_rows) for i in range(5)))

    def chunks() -> Iterator[tuple]:
        number = 0

        def counted(row: tuple) -> int:
            nonlocal number
            number += row[3] == 0
            return number

        for _, run in groupby(stream(), counted):
            name, lead, head, _, part = next(run)

            def placed(first: str = part, offset: int = lead, rest: Iterator[tuple] = run) -> Iterator[Placed]:
                for text in chain([first], (r[4] for r in rest)):
                    yield Placed(text, [(0, offset)])
                    offset += len(text) + how.gap

            for at, (x, kind, path) in enumerate(how.fold(placed())):
                yield name, at, (f"{head}\n\n" if head and kind == "definition" else "") + x.text, *x.span(), kind, list(path)

    made = chunks()
    while rows := list(islice(made, 1000)):
        columns = list(zip(*rows))
        types = [kept["id"], pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["id", "at", "text", "start", "end", "kind", "path"])


#: Abbreviations that end no sentence.
ABBREVIATIONS = ("mr.", "mrs.", "ms.", "dr.", "prof.", "sr.", "jr.", "st.", "e.g.", "i.e.", "etc.", "vs.", "u.s.", "u.k.", "ph.d.", "m.d.", "a.m.", "p.m.", "no.")


def clauses(text: str, least: int = 4, most: int = 24) -> list[str]:
    """Sentences of a text, long ones halved at the comma or word nearest to the middle, short ones joined to the next."""
    words, sentences = [], []
    for w in text.split():
        words.append(w)
        bare = w.rstrip("\"')]}»”")
        if bare[-1:] in "!?" and bare or bare.endswith(".") and bare.lower() not in ABBREVIATIONS and not re.fullmatch(r"\d+\.", bare):
            sentences.append(words)
            words = []
    sentences += [words] if words else []
    parts: list[list[str]] = []

    def halve(x: list[str]) -> None:
        if len(x) <= most:
            parts.append(x)
            return
        middle = len(x) / 2
        at = min((i + 1 for i, w in enumerate(x[:-1]) if w[-1] in ",;:"), key=lambda i: abs(i - middle), default=len(x) // 2)
        halve(x[:at]), halve(x[at:])

    for s in sentences:
        halve(s)
    out: list[list[str]] = []
    held: list[str] = []
    for x in parts:
        held = held + x
        if len(held) >= least:
            out.append(held)
            held = []
    if held:
        out = [*out[:-1], out[-1] + held] if out else [held]
    return [" ".join(x) for x in out]


@F.pandas_udf(T.ArrayType(T.StringType()))
def clause_list(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for texts in batches:
        yield texts.map(lambda t: clauses(t or ""))


def adjacent_similarity(segments: DataFrame, by: str, at: str, vector: str) -> DataFrame:
    """segments with `similarity` to the next segment of the same text; null for the last."""
    following = F.lead(vector).over(Window.partitionBy(by).orderBy(at))
    return segments.withColumn("__next", following).withColumn("similarity", F.when(F.col("__next").isNotNull(), V.cosine_similarity(F.col(vector), F.col("__next")))).drop("__next")


def semantic_groups(segments: DataFrame, by: str, at: str, vector: str, threshold: float | None = None) -> DataFrame:
    """segments with `similarity` and `chunk`, which goes up by one behind each segment whose similarity to the next is below the threshold.

    Without a threshold, each text has its own: the mean of its similarities less one population deviation; a lone one less 0.01.
    """
    s = adjacent_similarity(segments, by, at, vector)
    whole = Window.partitionBy(by)
    n, mean, spread = F.count("similarity").over(whole), F.avg("similarity").over(whole), F.stddev_pop("similarity").over(whole)
    limit = F.lit(threshold) if threshold is not None else F.when(n == 1, mean - 0.01).otherwise(mean - spread)
    s = s.withColumn("__break", F.coalesce((F.col("similarity") < limit).cast("int"), F.lit(0)))
    before = F.sum("__break").over(Window.partitionBy(by).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    return s.withColumn("chunk", F.coalesce(before, F.lit(0))).drop("__break")


def resized(breaks: list[bool], similarities: list[float], lengths: list[int], most: int, least: int) -> list[int]:
    """Chunk of each segment once chunks longer than `most` are split and those shorter than `least` are merged.

    breaks[i] and similarities[i] belong to the boundary behind segment i. A chunk's length counts a blank between its
    segments. Too long chunks are cut at their least similar boundary, the first of equals, until they fit or are one
    segment; then the first too short chunk joins its more similar neighbour (the earlier of equals) until none is left.
    """
    n, ends = len(lengths), np.concatenate([[0], np.cumsum(lengths)])
    size = lambda a, b: int(ends[b] - ends[a]) + b - a - 1
    starts = [0, *(i + 1 for i in range(n - 1) if breaks[i])]
    open_, fitting = list(zip(starts, [*starts[1:], n])), []
    while open_:
        a, b = open_.pop()
        if b - a > 1 and size(a, b) > most:
            cut = a + 1 + int(np.argmin(similarities[a : b - 1]))
            open_ += [(a, cut), (cut, b)]
        else:
            fitting.append(a)
    edges, i = [*sorted(fitting), n], 0
    while i < len(edges) - 1 and len(edges) > 2:
        if size(edges[i], edges[i + 1]) >= least:
            i += 1
            continue
        left = i == len(edges) - 2 or i > 0 and similarities[edges[i] - 1] >= similarities[edges[i + 1] - 1]
        del edges[i if left else i + 1]
        i -= left
    return (np.searchsorted(edges, np.arange(n), "right") - 1).tolist()


def semantic_chunks(segments: DataFrame, by: str, at: str, text: str, vector: str, threshold: float | None = None, most: int = 2000, least: int = 100) -> DataFrame:
    """(by, chunk, first, last, text): the segments of each text in semantic groups of `least` to `most` characters (see resized).

    The segments of one text are handled together, so a task holds a text at a time.
    """
    grouped = semantic_groups(segments.select(by, at, text, vector), by, at, vector, threshold).select(by, at, text, "similarity", "chunk")
    schema = T.StructType([segments.schema[by], T.StructField("chunk", T.LongType()), T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("text", T.StringType())])

    def build(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(at)
        texts, chunk = x[text].fillna("").tolist(), x["chunk"].tolist()
        found = resized([a != b for a, b in zip(chunk, chunk[1:])], x["similarity"].fillna(0.0).tolist(), [len(t) for t in texts], most, least)
        x = pd.DataFrame({by: x[by], "chunk": found, "at": x[at], "text": texts})
        return x.groupby("chunk", as_index=False).agg(**{by: (by, "first"), "first": ("at", "min"), "last": ("at", "max"), "text": ("text", " ".join)})[[by, "chunk", "first", "last", "text"]]

    return grouped.groupBy(by).applyInPandas(build, schema)


def chunked(docs: DataFrame, how: Chunker | Callable[[Column], Column], id_col: str = "id", text_col: str = "text", prefix: str = "chunk") -> DataFrame:
    """(chunk_id, id, at, text, start, end, kind, path): a row for each chunk of each document.

    Spark cuts the texts into parts, and the parts of a document, which stay together and in order, are folded as they
    come: nothing is shuffled, and Python holds a batch of parts and a block, however long the text is. A chunker of one's
    own is a Chunker, or a function from the text to an array of CHUNKS. Null, empty and blank texts have no chunks; rows
    that repeat an id are documents of their own; other columns are left out.
    """
    if isinstance(how, Chunker):
        text = F.coalesce(F.col(text_col), F.lit(""))
        lead = F.length(F.regexp_extract(text, f"^{WHITE}*", 0)) if not how.gap else F.lit(0)
        inner = F.regexp_replace(text, f"^{WHITE}+|{WHITE}+$", "") if not how.gap else text
        head = how.head(text) if how.head else F.lit(None).cast("string")
        parts = docs.where(text != "").select(F.col(id_col).alias("id"), lead.alias("lead"), head.alias("head"), F.posexplode(how.parts(inner)).alias("at", "part"))
        schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), *T.StructType.fromDDL("at int, text string, start int, `end` int, kind string, path array<string>").fields])
        found = parts.mapInArrow(lambda batches: _folded(batches, how), schema)
    else:
        found = docs.select(F.col(id_col).alias("id"), F.explode(how(F.col(text_col))).alias("c")).select("id", "c.*")
    return found.select(F.concat_ws("_", F.lit(prefix), F.col("id").cast("string"), F.col("at").cast("string")).alias("chunk_id"), *found.columns)
