"""Documents as a Python data source: files of lines read by byte ranges, tables under a log of commits, streams over either, and loaders of one's own.

    spark.dataSource.register(data_source("tickets", parse))
    spark.read.format("tickets").load(path)
    spark.readStream.format("tickets").option("log", folder).load(path)
    df.write.format("tickets").mode("append").save(table)

A table is a folder of files and a log: an entry names the files of one commit, and files that no entry names are not
read. So what a failed, repeated or speculative task has left behind never shows, and a micro-batch that runs again finds
its entry. Paths are opened by Arrow's file systems (local, s3, gs, hdfs). A table has one writer at a time.
"""

from __future__ import annotations

import io
import json
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, DataSourceArrowWriter, InputPartition, WriterCommitMessage

from heron.sources.formats import TEXT_COLUMNS

SCHEMA = "id string, text string, source string, metadata map<string,string>"
ARROW = pa.schema([("id", pa.string()), ("text", pa.string()), ("source", pa.string()), ("metadata", pa.map_(pa.string(), pa.string()))])
#: Bytes of a range, a block that is read, and a batch that is handed to Spark.
RANGE, BLOCK, BATCH = 128 << 20, 1 << 20, 4 << 20
PACKED = (".gz", ".bz2", ".zst", ".lz4")

#: One document: id, text, source, metadata.
Document = tuple[str | None, str | None, str | None, dict[str, str]]
#: A line, the path of its file and its offset there, to any number of documents.
Parse = Callable[[bytes, str, int], Iterable[Document]]


# ---- parsers --------------------------------------------------------------------------------------------------------


def text_line(line: bytes, source: str, at: int) -> Iterator[Document]:
    """A document for each line that isn't blank, named by its file and its offset."""
    text = line.decode("utf-8", "replace").strip()
    if text:
        yield f"{source}#{at}", text, source, {"offset": str(at)}


def _scalar(value: object) -> str | None:
    if value is None or isinstance(value, str):
        return value
    return json.dumps(value, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def json_line(line: bytes, source: str, at: int) -> Iterator[Document]:
    """An object for each line, as loaders.json_documents with lines=True reads it; blank lines are left out."""
    if not line.strip():
        return
    record = json.loads(line)
    fields = record if isinstance(record, dict) else {}
    values = {k: _scalar(v) for k, v in fields.items()}
    text = next((values[k] for k in TEXT_COLUMNS if values.get(k) is not None), None)
    yield values.get("id"), _scalar(record) if text is None else text, None, {k: v for k, v in values.items() if v is not None and len(v) < 200}


def row_line(line: bytes, source: str, at: int) -> Iterator[Document]:
    """A row of a table that was written by this source, as it was."""
    r = json.loads(line)
    yield r["id"], r["text"], r["source"], dict(r["metadata"]) if r["metadata"] is not None else None


PARSERS: dict[str, Parse] = {"text": text_line, "json": json_line}


# ---- files and ranges -----------------------------------------------------------------------------------------------


def opened(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path and not path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")


def listed(path: str) -> list[tuple[str, int]]:
    """(file, bytes) below a path in order of their names; hidden ones, whose name or folder begins with _ or a dot, are left out."""
    system, base = opened(path)
    if system.get_file_info(base).type == fs.FileType.File:
        return [(base, system.get_file_info(base).size)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
    shown = lambda f: not any(part[:1] in "_." for part in f.path[len(base) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and shown(f))


@dataclass
class Range(InputPartition):
    """Lines of a file that begin at start or later and before end; end is None for a packed file, which is read whole."""

    path: str
    start: int
    end: int | None


def ranges(files: list[tuple[str, int]], size: int) -> list[Range]:
    return [r for path, n in files for r in ([Range(path, 0, None)] if path.endswith(PACKED) else [Range(path, a, min(a + size, n)) for a in range(0, n, size)])]


def lines(system: fs.FileSystem, part: Range) -> Iterator[tuple[int, bytes]]:
    """(offset, line without its end) of a range. A line belongs to the range in which it begins, so each is read once, whatever its length."""
    if part.end is None:
        stream, at = io.BufferedReader(system.open_input_stream(part.path, compression="detect"), BLOCK), 0
    else:
        stream, at = io.BufferedReader(system.open_input_file(part.path), BLOCK), max(part.start - 1, 0)
    with stream:
        if at:
            stream.seek(at)
        if part.start:
            at += len(stream.readline())
        while part.end is None or at < part.end:
            line = stream.readline()
            if not line:
                return
            yield at, line.rstrip(b"\r\n")
            at += len(line)


class Reading:
    """What the reader and the stream reader share: options, and the documents of a range as Arrow batches."""

    def __init__(self, parse: Parse, options: dict[str, str]):
        self.path, self.parse = options["path"], parse
        self.size = int(options.get("rangeBytes", RANGE))
        self.permissive = options.get("mode", "FAILFAST").upper() == "PERMISSIVE"

    def documents(self, part: Range) -> Iterator[Document]:
        system, _ = opened(self.path)
        for at, line in lines(system, part):
            try:
                yield from self.parse(line, part.path, at)
            except Exception as e:
                if not self.permissive:
                    raise ValueError(f"{part.path} at byte {at}: {e}") from e
                yield None, line.decode("utf-8", "replace"), part.path, {"_error": f"{type(e).__name__}: {e}", "_offset": str(at)}

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        rows: list[Document] = []
        held = 0
        for row in self.documents(part):
            rows.append(row)
            held += len(row[1] or "") + 100
            if held >= BATCH:
                yield batch_of(rows)
                rows, held = [], 0
        if rows:
            yield batch_of(rows)


def batch_of(rows: list[Document]) -> pa.RecordBatch:
    ids, texts, sources, metadata = zip(*rows)
    maps = [None if m is None else list(m.items()) for m in metadata]
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(texts, pa.string()), pa.array(sources, pa.string()), pa.array(maps, ARROW.field("metadata").type)], schema=ARROW)


# ---- the log of a table ---------------------------------------------------------------------------------------------


class Log:
    """Numbered entries {key, files, replaces} in a folder; an entry counts once it is written, and a key is written once."""

    def __init__(self, folder: str):
        self.system, self.folder = opened(folder)

    def numbers(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(self.folder, allow_not_found=True))
        return sorted(int(f.base_name[:-5]) for f in found if f.base_name.endswith(".json"))

    def entry(self, number: int) -> dict:
        with self.system.open_input_stream(f"{self.folder}/{number:020d}.json") as f:
            return json.loads(f.read())

    def files(self) -> list[tuple[str, int]]:
        """The files of all entries from the last one on that replaces what was there."""
        out: list[tuple[str, int]] = []
        for n in self.numbers():
            e = self.entry(n)
            out = ([] if e["replaces"] else out) + [(path, size) for path, size in e["files"]]
        return out

    def add(self, key: str, files: list[tuple[str, int]], replaces: bool = False) -> None:
        numbers = self.numbers()
        if any(self.entry(n)["key"] == key for n in reversed(numbers)):
            return
        self.system.create_dir(self.folder, recursive=True)
        number = numbers[-1] + 1 if numbers else 0
        pending = f"{self.folder}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(pending) as f:
            f.write(json.dumps({"key": key, "files": files, "replaces": replaces}).encode())
        self.system.move(pending, f"{self.folder}/{number:020d}.json")


def log_of(path: str) -> Log:
    return Log(f"{path.rstrip('/')}/_log")


# ---- readers --------------------------------------------------------------------------------------------------------


class Reader(Reading, DataSourceReader):
    def __init__(self, parse: Parse, options: dict[str, str]):
        table = bool(log_of(options["path"]).numbers())
        super().__init__(row_line if table else parse, options)
        self.table = table

    def partitions(self) -> list[Range]:
        files = log_of(self.path).files() if self.table else listed(self.path)
        return ranges(files, self.size) or [Range("", 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        return super().read(part) if part.path else iter(())


class StreamReader(Reading, DataSourceStreamReader):
    """Offsets count entries of a log: that of the table, or for a plain folder one of its own in option `log`, to which each look at the folder adds the new files."""

    def __init__(self, parse: Parse, options: dict[str, str]):
        self.table = bool(log_of(options["path"]).numbers())
        super().__init__(row_line if self.table else parse, options)
        if not self.table and "log" not in options:
            raise ValueError("a stream over a folder without a log needs one: option('log', folder)")
        self.log = log_of(self.path) if self.table else Log(options["log"])

    def initialOffset(self) -> dict:
        return {"entries": 0}

    def latestOffset(self) -> dict:
        if not self.table:
            seen = {path for path, _ in self.log.files()}
            new = [f for f in listed(self.path) if f[0] not in seen]
            if new:
                self.log.add(uuid.uuid4().hex, new)
        return {"entries": len(self.log.numbers())}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        entries = [self.log.entry(n) for n in range(start["entries"], end["entries"])]
        if any(e["replaces"] and n + start["entries"] for n, e in enumerate(entries)):
            raise ValueError(f"{self.path} was overwritten while a stream reads it; start the stream anew")
        return ranges([(path, size) for e in entries for path, size in e["files"]], self.size)

    def commit(self, end: dict) -> None:
        """Entries stay: other streams may read them."""


# ---- writers --------------------------------------------------------------------------------------------------------


@dataclass
class Written(WriterCommitMessage):
    path: str
    size: int
    rows: int


class Writing:
    """Each task writes a file under a name of its own and reports it; only the driver's commit makes files part of the table."""

    def __init__(self, path: str, overwrite: bool, name: str):
        self.path, self.overwrite, self.name = path.rstrip("/"), overwrite, name

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, base = opened(self.path)
        system.create_dir(f"{base}/data", recursive=True)
        path, size, rows = f"{base}/data/{uuid.uuid4().hex}.jsonl", 0, 0
        with system.open_output_stream(path, buffer_size=BLOCK) as f:
            for batch in batches:
                for row in batch.select(ARROW.names).to_pylist():
                    line = json.dumps(row, ensure_ascii=False).encode("utf-8") + b"\n"
                    f.write(line)
                    size, rows = size + len(line), rows + 1
        return Written(path, size, rows)

    def _commit(self, messages: list[Written | None], key: str) -> None:
        log_of(self.path).add(key, [(m.path, m.size) for m in messages if m is not None and m.rows], self.overwrite)

    def _abort(self, messages: list[Written | None]) -> None:
        system, _ = opened(self.path)
        for m in messages:
            if m is not None and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


class Writer(Writing, DataSourceArrowWriter):
    def commit(self, messages: list[Written | None]) -> None:
        self._commit(messages, uuid.uuid4().hex if self.name == "" else f"write-{self.name}")

    def abort(self, messages: list[Written | None]) -> None:
        self._abort(messages)


class StreamWriter(Writing, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:
        self._commit(messages, f"stream-{self.name}-{batchId}")

    def abort(self, messages: list[Written | None], batchId: int) -> None:
        self._abort(messages)


# ---- the source -----------------------------------------------------------------------------------------------------


class Documents(DataSource):
    """Options: path, parser (text or json; sources of one's own bring theirs), rangeBytes, mode (FAILFAST ends the job at a line that can't be parsed, PERMISSIVE keeps it as a document whose metadata has `_error`), log (streams over plain folders) and writeName (a write that runs again under its name is done once; a stream needs one if several write to a table).

    An empty folder gives no rows; lines and texts may be of any length, as a line is held by one task at a time; null
    ids, texts and metadata of a table come back as nulls; equal rows stay apart; further columns of what is written are left out.
    """

    parse: Parse | None = None

    @classmethod
    def name(cls) -> str:
        return "heron_documents"

    def schema(self) -> str:
        return SCHEMA

    def _options(self) -> tuple[Parse, dict[str, str]]:
        options = {**self.options}
        lower = {k.lower(): v for k, v in options.items()}
        given = {name: lower[name.lower()] for name in ("path", "rangeBytes", "mode", "log", "writeName", "parser") if name.lower() in lower}
        if "path" not in given:
            raise ValueError("give a path")
        parse = type(self).parse or PARSERS.get(given.get("parser", "json"))
        if parse is None:
            raise ValueError(f"parser must be one of {sorted(PARSERS)}")
        return parse, given

    def reader(self, schema) -> Reader:
        return Reader(*self._options())

    def streamReader(self, schema) -> StreamReader:
        return StreamReader(*self._options())

    def writer(self, schema, overwrite: bool) -> Writer:
        options = self._options()[1]
        return Writer(options["path"], overwrite, options.get("writeName", ""))

    def streamWriter(self, schema, overwrite: bool) -> StreamWriter:
        options = self._options()[1]
        return StreamWriter(options["path"], False, options.get("writeName", ""))


def data_source(format_name: str, parse: Parse) -> type[DataSource]:
    """A source under a name of one's own whose lines are read by `parse`; give it to spark.dataSource.register."""
    return type(format_name, (Documents,), {"name": classmethod(lambda cls: format_name), "parse": staticmethod(parse)})
