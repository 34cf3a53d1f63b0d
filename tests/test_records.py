"""The data source of documents: ranges, commits, streams, own parsers."""

import gzip
import json
import random

import pytest
from pyspark.sql import functions as F

from heron.sources import loaders, records


@pytest.fixture(scope="module")
def source(spark):
    spark.dataSource.register(records.Documents)
    return "heron_documents"


def rows(df):
    return sorted(((r.id, r.text, r.source, tuple(sorted((r.metadata or {}).items()))) for r in df.collect()), key=repr)


def json_lines():
    rng = random.Random(5)
    out = [{"id": str(i), "text": "ä" * rng.randrange(0, 90), "n": i, "x": i + 0.5, "ok": i % 2 == 0, "none": None} for i in range(300)]
    out += [{"id": "big", "text": "long " * 20_000}, {"title": "only a title"}, {"id": "o", "by": {"name": "N"}}, {"id": "same"}, {"id": "same"}]
    return out


@pytest.mark.parametrize("size", [64, 1000, 1 << 20])
def test_ranges_read_each_line_once(spark, source, tmp_path, size):
    path = tmp_path / "a.jsonl"
    path.write_text("\n\n".join(json.dumps(r, ensure_ascii=False) for r in json_lines()) + "\r\n", encoding="utf-8")
    df = spark.read.format(source).option("rangeBytes", max(size, 500)).load(str(path))
    assert rows(df) == rows(loaders.load(spark, str(path), "json", lines=True))
    system, base = records.opened(str(path))
    parts = records.ranges(records.listed(str(path)), size)
    found = [x for p in parts for x in records.lines(system, p)]
    whole = path.read_bytes().split(b"\n")
    assert [x for _, x in found] == [x.rstrip(b"\r") for x in whole[:-1]]
    assert [at for at, _ in found] == [sum(len(y) + 1 for y in whole[:i]) for i in range(len(whole) - 1)]


def test_packed_empty_and_broken_files(spark, source, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.gz").write_bytes(gzip.compress(b"one\n\n two \n"))
    (tmp_path / "a" / "y.txt").write_text("three")
    (tmp_path / "a" / "empty.txt").write_text("")
    (tmp_path / "a" / "_hidden").write_text("no")
    df = spark.read.format(source).option("parser", "text").load(str(tmp_path / "a"))
    assert [r.text for r in df.orderBy("text").collect()] == ["one", "three", "two"]
    (tmp_path / "none").mkdir()
    assert spark.read.format(source).load(str(tmp_path / "none")).count() == 0
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"id": "a", "text": "t"}\n{oops\n')
    kept = spark.read.format(source).option("mode", "PERMISSIVE").load(str(bad)).collect()
    assert [(r.id, r.text) for r in kept] == [("a", "t"), (None, "{oops")] and "_error" in kept[1].metadata and kept[1].metadata["_offset"] == "25"
    with pytest.raises(Exception, match="at byte 25"):
        spark.read.format(source).load(str(bad)).collect()
    with pytest.raises(Exception, match="parser must be"):
        spark.read.format(source).option("parser", "pdf").load(str(bad)).collect()


def test_tables_keep_rows_and_commits(spark, source, tmp_path):
    path = str(tmp_path / "t")
    made = [("1", "a\nb", "s", {"k": "v"}), (None, None, None, None), ("1", "a\nb", "s", {"k": "v"}), ("2", "", "ü", {})]
    df = spark.createDataFrame(made, records.SCHEMA)
    df.withColumn("extra", F.lit(1)).repartition(3).write.format(source).mode("append").save(path)
    assert rows(spark.read.format(source).load(path)) == rows(df)
    for _ in range(2):  # the second one is the first run again
        df.write.format(source).mode("append").option("writeName", "nightly").save(path)
    assert spark.read.format(source).load(path).count() == 8
    df.limit(1).write.format(source).mode("overwrite").save(path)
    assert spark.read.format(source).load(path).count() == 1


def test_failed_and_repeated_tasks_leave_nothing(spark, source, tmp_path):
    path = str(tmp_path / "t")
    batch = records.batch_of([("1", "a", None, {}), ("2", "b", None, {})])
    writer = records.Writer(path, False, "")
    lost, again = writer.write(iter([batch])), writer.write(iter([batch]))  # a speculative twin: only one of them reports
    writer.commit([again, None])
    assert lost.path != again.path and spark.read.format(source).load(path).count() == 2
    stream = records.StreamWriter(path, False, "q")
    for _ in range(2):  # a micro-batch that runs again after its commit
        stream.commit([stream.write(iter([batch]))], 0)
    assert spark.read.format(source).load(path).count() == 4
    failing = spark.range(100, numPartitions=4).select(F.when(F.col("id") == 99, F.raise_error(F.lit("lost"))).otherwise(F.col("id").cast("string")).alias("id"), F.lit("t").alias("text"), F.lit("s").alias("source"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata"))
    with pytest.raises(Exception):
        failing.write.format(source).mode("append").save(path)
    assert spark.read.format(source).load(path).count() == 4


def test_streams_resume_where_they_stopped(spark, source, tmp_path):
    folder, log, table, checkpoint = (str(tmp_path / x) for x in ("in", "log", "out", "checkpoint"))
    (tmp_path / "in").mkdir()

    def run():
        stream = spark.readStream.format(source).option("parser", "text").option("log", log).option("rangeBytes", 5).load(folder)
        stream.writeStream.format(source).option("writeName", "copy").option("checkpointLocation", checkpoint).option("path", table).trigger(availableNow=True).start().awaitTermination(120)
        return sorted(r.text for r in spark.read.format(source).load(table).collect())

    (tmp_path / "in" / "b.txt").write_text("one\ntwo\n")
    assert run() == ["one", "two"]
    (tmp_path / "in" / "a.txt").write_text("three\n")  # an earlier name
    assert run() == ["one", "three", "two"]
    assert run() == ["one", "three", "two"]
    copied = spark.readStream.format(source).load(table).writeStream.format("memory").queryName("copied").trigger(availableNow=True).start()
    copied.awaitTermination(120)
    assert spark.table("copied").count() == 3
    spark.createDataFrame([("x", "y", None, None)], records.SCHEMA).write.format(source).mode("overwrite").save(table)
    with pytest.raises(ValueError, match="overwritten"):
        records.StreamReader(records.json_line, {"path": table}).partitions({"entries": 0}, {"entries": len(records.log_of(table).numbers())})
    with pytest.raises(ValueError, match="needs one"):
        records.StreamReader(records.json_line, {"path": folder})


def test_a_source_of_ones_own(spark, tmp_path):
    def parse(line, source, at):
        for i, part in enumerate(line.decode().split("|")):
            yield f"{at}-{i}", part, None, {}

    spark.dataSource.register(records.data_source("piped", parse))
    (tmp_path / "p.txt").write_text("a|b\nc\n")
    got = spark.read.format("piped").load(str(tmp_path / "p.txt")).collect()
    assert sorted((r.id, r.text) for r in got) == [("0-0", "a"), ("0-1", "b"), ("4-0", "c")]
