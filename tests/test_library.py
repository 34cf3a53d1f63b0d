"""What SQL can't check: recall, streams, wrappers, chunkers and parsers against brute force and planted cases."""

import json
import random
import re

import numpy as np
import pandas as pd
import plain_chunks
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from heron.functions import chunking, jsontext, models
from heron.functions import text as X
from heron.operators import codes, duplicates, fusion, keyword, logs, metrics, quantize, ranges, search, segments
from heron.plans import catalog
from heron.sources import collections, formats, loaders
from heron.streaming import answers, ingest, limits, turns, voice, windows


def vectors(spark, n, dims=32, seed=1, planted=()):
    rng = np.random.default_rng(seed)
    v = rng.standard_normal((n, dims))
    for a, b, noise in planted:
        v[b] = v[a] + noise * rng.standard_normal(dims)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    return v, spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, vector array<float>")


# ---- duplicates, indexes and codes ----------------------------------------------------------------------------------


def close_pairs(v, threshold):
    s = v @ v.T
    return {(i, j) for i in range(len(v)) for j in range(i + 1, len(v)) if s[i, j] >= threshold}


def test_similar_pairs_in_blocks_equal_brute_force(spark):
    v, rows = vectors(spark, 300, planted=[(i, i + 150, 0.1) for i in range(0, 100, 3)])
    for block in (7, 64, 4096):
        found = search.similar_pairs(rows, 0.6, block=block).collect()
        assert {(r.a, r.b) for r in found} == close_pairs(v, 0.6) and len(found) == len(close_pairs(v, 0.6))


@pytest.mark.parametrize("bucket", [512, 4])
def test_signatures_find_planted_pairs(spark, monkeypatch, bucket):
    monkeypatch.setattr(duplicates, "BUCKET", bucket)
    v, rows = vectors(spark, 900, planted=[(i, i + 450, 0.05) for i in range(0, 450, 2)])
    want = close_pairs(v, 0.9)
    found = {(r.a, r.b) for r in duplicates.similar_pairs(rows, 0.9).collect()}
    assert found <= want and len(want) > 200 and len(found) >= 0.99 * len(want)
    groups = duplicates.similar_groups(rows, 0.9)
    assert duplicates.redundant(groups).count() == groups.count() - groups.select("component").distinct().count()


def test_equal_vectors_are_collapsed(spark):
    rows = spark.createDataFrame([(i, [1.0, float(i % 2), 0.5]) for i in range(400)], "id long, vector array<float>")
    for exact in (True, False):
        found = duplicates.similar_pairs(rows, 0.95, exact=exact).collect()
        assert len(found) == 398 and {r.component for r in duplicates.similar_groups(rows, 0.95, exact=exact).collect()} == {0, 1}


def test_recall_of_indexes(spark, data):
    assert np.mean([r.recall for r in catalog.QUERIES["vec_ivf_recall"](spark, data).collect()]) >= 0.9
    assert catalog.QUERIES["pq_recall"](spark, data).first().recall >= 0.9


def test_batch_search_of_strings_and_blocks(spark, monkeypatch):
    v, rows = vectors(spark, 120)
    queries = rows.where("id % 20 = 0").select(F.concat(F.lit("q"), F.col("id")).alias("query_id"), "vector")
    whole = search.batch_top_k(rows, queries, 5).collect()
    monkeypatch.setattr(search, "QUERY_BLOCK", 2), monkeypatch.setattr(search, "ROW_BLOCK", 50)
    key = lambda rows_: sorted((r.query_id, r["rank"], r.id) for r in rows_)
    assert key(search.batch_top_k(rows, queries, 5).collect()) == key(whole) == sorted((f"q{q}", k + 1, int(i)) for q in range(0, 120, 20) for k, i in enumerate(np.argsort(-(v @ v[q]), kind="stable")[:5]))
    assert search.batch_top_k(rows, queries.limit(0), 5).count() == 0


def test_kmeans_inertia(spark):
    rng = np.random.default_rng(3)
    centres = rng.uniform(-50, 50, (6, 4))
    x = np.concatenate([c + rng.standard_normal((80, 4)) for c in centres])
    rows = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vector array<double>")
    best = sum(((x[i * 80 : i * 80 + 80] - x[i * 80 : i * 80 + 80].mean(axis=0)) ** 2).sum() for i in range(6))
    assert quantize.inertia(rows, search.fit_centroids(rows, 6, sample=None)).first().inertia < 4 * best
    assert abs(quantize.inertia(rows, x[:1]).first().inertia - ((x - x[0]) ** 2).sum()) < 1e-6 * ((x - x[0]) ** 2).sum()


def test_stored_codes(spark, tmp_path):
    """Rough scores are those of the decoded vectors, for every metric; probes see their lists only; null vectors are left out."""
    rng = np.random.default_rng(4)
    x, q = rng.standard_normal((300, 8)), rng.standard_normal((5, 8))
    rows = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(999, None)], "id long, vector array<float>")
    asked = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(q)], "query_id long, vector array<float>")
    codes.write_codes(rows, str(tmp_path / "c"), m=4, k=16, lists=3)
    stored = codes.Codes(spark, str(tmp_path / "c"))
    coded = {r.id: (np.concatenate([b[c] for b, c in zip(stored.books, bytes(r.code))]), r.cid) for r in stored.codes.collect()}
    assert sorted(coded) == list(range(300))
    for metric in ("cosine", "dot", "euclidean"):
        for r in stored.candidates(asked, 300, metric).collect():
            a, b = q[r.query_id], coded[r.id][0]
            size = np.linalg.norm(x[r.id])
            want = {"cosine": a @ b / np.linalg.norm(a) / size, "dot": a @ b, "euclidean": -(a @ a + size**2 - 2 * a @ b)}[metric]
            assert abs(r.rough - want) < 1e-4
    near = ((stored.centroids**2).sum(axis=1) - 2 * q @ stored.centroids.T).argmin(axis=1)
    assert all(coded[r.id][1] == near[r.query_id] for r in stored.candidates(asked, 50, probes=1).collect())
    whole = stored.search(asked, 5, wider=60).collect()  # all rows are read: exact
    assert sorted((r.query_id, r["rank"], r.id) for r in whole) == sorted((r.query_id, r["rank"], r.id) for r in search.batch_top_k(rows, asked, 5).collect())
    assert stored.search(asked.limit(0), 5).count() == 0


# ---- keyword index --------------------------------------------------------------------------------------------------


def files_of(path):
    return {str(p): p.stat().st_mtime_ns for p in path.rglob("*") if p.is_file() and not p.name.startswith(".")}


def segment_texts(n, seed):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    return [(i, rng.choice([None, ""]) if rng.random() < 0.05 else " ".join(rng.choices(words, [1 / (j + 1) for j in range(60)], k=rng.randint(1, 60))), [rng.gauss(0, 1) for _ in range(4)]) for i in range(n)]


TEXTS = "id long, text string, vector array<float>"


def test_segments_equal_a_rebuilt_index(spark, tmp_path, monkeypatch):
    """Additions, replacements, removals and merges in any order; nothing written is touched, and a failed or repeated write changes nothing twice."""
    monkeypatch.setattr(segments, "FAN", 3)
    store = segments.Store(spark, str(tmp_path / "s"), with_vectors=True, window=4, buckets=4)
    asked = spark.createDataFrame([(0, "w0 w3 w3 w59 w17"), (1, "unknown"), (2, None), (3, "w55 w56 w57 w58")], "query_id long, text string")
    vectors = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (3, [0.0, 1.0, 1.0, 0.0])], "query_id long, vector array<float>")
    now, rng = {}, random.Random(2)
    assert store.snapshot().search(asked).count() == 0
    for step in range(6):
        before = files_of(tmp_path / "s") if step else {}
        if step in (2, 4):
            gone = rng.sample(sorted(now), 5) + [10_000]
            frame = spark.createDataFrame([(i,) for i in gone], "id long")
            change = lambda: store.remove(frame, f"step {step}")  # noqa: B023, E731
            after = {i: r for i, r in now.items() if i not in gone}
        else:
            rows = [(i + 7 * step, t, v) for i, t, v in segment_texts(12, step)]
            frame = spark.createDataFrame(rows, TEXTS)
            change = lambda: store.add(frame, f"step {step}")  # noqa: B023, E731
            after = now | {r[0]: r for r in rows}
        if step in (1, 2):  # the write ends before its version is there
            commit = segments.Store._commit
            monkeypatch.setattr(segments.Store, "_commit", lambda *a: 1 / 0)
            with pytest.raises(ZeroDivisionError):
                change()
            monkeypatch.setattr(segments.Store, "_commit", commit)
            assert sorted(r.id for r in store.snapshot().documents().collect()) == sorted(now)
        assert change() == change()
        now = after
        assert all(files_of(tmp_path / "s").get(f) == t for f, t in before.items())
        here, rebuilt = store.snapshot(), keyword.built(spark.createDataFrame(sorted(now.values()), TEXTS))
        hits = lambda found: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in found.collect())
        want = hits(keyword.search(rebuilt, asked, 5))
        assert hits(here.search(asked, 5)) == want
        if step not in (2, 5):
            continue
        assert hits(here.search(asked, 5, bounded=True)) == want
        assert sorted(tuple(r)[:2] for r in here.search(asked, None).collect()) == sorted(tuple(r)[:2] for r in keyword.search(rebuilt, asked, None).collect())
        stats, anew = here.stats().first(), keyword.corpus_stats(rebuilt).first()
        assert (stats.n_docs, stats.vocabulary) == (anew.n_docs, anew.vocabulary) and abs(stats.avg_dl - anew.avg_dl) < 1e-9
        legs = search.batch_top_k(spark.createDataFrame(sorted(now.values()), TEXTS), vectors, 15), keyword.search(rebuilt, asked.join(vectors, "query_id").select("query_id", "text"), 15)
        assert hits(here.hybrid(asked.join(vectors, "query_id"), 5)) == hits(fusion.hybrid(*legs, k=5))
    assert store.version().number > 6  # merges are versions
    first = store.snapshot(1)
    assert sorted(r.id for r in first.documents().collect()) == list(range(12))  # an older version reads as it was
    store.vacuum()
    assert hits(store.snapshot().search(asked, 5)) == want and len(store.versions()) == 1
    kept = {s["name"] for s in store.version().segments}
    assert {p.name.partition("=")[2] for p in (tmp_path / "s/forward").glob("segment=*")} == kept
    store.clear("all")
    assert store.snapshot().search(asked).count() == 0 and store.snapshot().n_docs == 0


def test_segments_of_two_writers(spark, tmp_path):
    store = segments.Store(spark, str(tmp_path / "s"))
    base = store.version()
    store.add(spark.createDataFrame([(1, "red fox")], "id long, text string"))
    with pytest.raises(segments.Conflict):
        store._commit(base, [], None)
    assert store.snapshot().n_docs == 1 and not list((tmp_path / "s/log").glob("*.tmp"))


def test_segments_read_few_folders_and_blocks(spark, tmp_path):
    """The scan gets buckets and terms as literals; rare terms in few documents leave most posting rows of a frequent term unread."""
    rng = random.Random(5)
    rows = [(i, " ".join(["the"] * rng.randint(1, 3) + [f"x{rng.randrange(400)}" for _ in range(20)]) + (" zebra quagga okapi" if i % 97 == 0 else "")) for i in range(1500)]
    store = segments.Store(spark, str(tmp_path / "s"), window=8)
    docs, asked = spark.createDataFrame(rows, "id long, text string"), spark.createDataFrame([(0, "the zebra quagga okapi")], "query_id long, text string")
    store.add(docs)
    here = store.snapshot()
    plan = here.blocks(asked, ["zebra", "okapi"])._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[.*bucket#\d+ (IN|=|INSET)", plan) and re.search(r"PushedFilters: \[.*In\(term, \[", plan)
    hits = lambda found: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in found.collect())
    assert hits(here.search(asked, 5, bounded=True)) == hits(keyword.bm25(docs, asked, 5))
    share = here.blocks_read(asked, 5).first()
    assert share.blocks > 180 and share.blocks_read < 0.4 * share.blocks


# ---- streams --------------------------------------------------------------------------------------------------------


def streamed(spark, tmp_path, batches, schema, apply):
    """Rows of a query over a stream that reads one file after the other."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i:03d}"))
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    out = apply(source)
    q = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
    q.awaitTermination()
    return [tuple(r) for r in spark.read.schema(out.schema).parquet(str(tmp_path / "out")).collect()]


def test_late_rows_are_dropped(spark, tmp_path):
    from datetime import datetime

    at = lambda h, m: (datetime(2024, 1, 1, h, m),)
    batches = [[at(10, 5), at(10, 50)], [at(12, 0)], [at(12, 1)], [at(10, 20), at(11, 55)], [at(15, 0)], [at(18, 0)]]
    found = streamed(spark, tmp_path, batches, "ts timestamp", lambda s: windows.rates(s, "ts", "1 hour", None, "10 minutes"))
    assert {r[0].hour: r[2] for r in found} == {10: 2, 11: 1, 12: 2, 15: 1}


def run_twice(spark, tmp_path, batches, schema, apply, between=None):
    """Rows of a stream of state machines over batches, stopped after the first half of them and started again from its checkpoint."""
    out, half = None, len(batches) // 2
    for part in (batches[:half], batches[half:]):
        for rows in part:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{len(list((tmp_path).glob('in/*'))):03d}"))
        source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        found = apply(source)
        with turns.state_store(spark):
            found.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "log")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start().awaitTermination()
        out = [tuple(r) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()]
        if between is not None and part is not batches[half:]:
            between(out)
            between = None
    return out


FRAME = "stream long, at timestamp, level double"


def test_utterances_of_a_stream_equal_those_of_a_table(spark, tmp_path):
    """Caps, ends, partial rows and silences, over micro-batches with a restart between them; a silence is seen by a timer before the next frame comes."""
    from datetime import datetime, timedelta, timezone

    rng, how = random.Random(7), turns.Listening(cap_ms=4000, silent_ms=5000)
    begin, at, batches = datetime(2024, 1, 1, tzinfo=timezone.utc), {k: 0 for k in range(3)}, []
    for b in range(6):
        rows = []
        for k in at:
            if k == 2 and b in (1, 2, 3, 4):
                continue  # speaks at the end of the first batch, and then isn't heard for long
            while at[k] < 20_000 * (b + 1):
                loud = (at[k] // 3000) % 2 == 0 or k == 1 or k == 2
                rows.append((k, begin + timedelta(milliseconds=at[k]), -20.0 - rng.random() if loud and rng.random() < 0.98 else -60.0))
                at[k] += rng.choice((100, 200, 300)) if rng.random() < 0.99 or k == 2 else 7000
            if k == 2:
                at[k] = 100_000
        batches.append(rows)
    apply = lambda rows: turns.utterances(rows, "stream", "at", "level", how)
    seen = lambda out: [r for r in out if r[0] == 2 and r[2] == "final" and r[8] and r[5] < 21_000 + begin.timestamp() * 1000]
    found = run_twice(spark, tmp_path, batches, FRAME, apply, lambda out: seen(out) or pytest.fail("no timer"))
    want = [tuple(r) for r in turns.utterances_of(spark.createDataFrame([r for b in batches for r in b], FRAME), "stream", "at", "level", how).collect()]
    # At the end of the stream, timers close what the end of a table leaves open.
    left = [r for r in found if r not in want]
    assert sorted(map(repr, want)) == sorted(repr(r) for r in found if r in want) and len(left) <= 3 and all(r[2] == "final" and r[8] for r in left)
    kinds = {(r[2], r[8]) for r in want}
    assert {("partial", False), ("final", False), ("final", True)} <= kinds


def test_late_frames_change_nothing(spark, tmp_path):
    from datetime import datetime, timezone

    at = lambda s: datetime.fromtimestamp(1_704_067_200 + s, timezone.utc)
    batches = [[(1, at(s / 10), -20.0) for s in range(20)], [(1, at(0.55), -60.0), (1, at(2.0), -20.0)], [(1, at(2 + s / 10), -60.0) for s in range(1, 12)], [(1, at(50), -60.0)], [(1, at(51), -60.0)], [(1, at(52), -60.0)], [(1, at(30), -20.0)], [(1, at(53), -60.0)]]
    found = run_twice(spark, tmp_path, batches, FRAME, lambda rows: turns.utterances(rows, "stream", "at", "level"))
    finals = [r for r in found if r[2] == "final"]
    assert [r[2] for r in found].count("late") == 1 and len(finals) == 1 and finals[0][6] == 19 + 9 and not finals[0][8]  # the frame behind the watermark is dropped


def test_turns_of_a_stream(spark, tmp_path):
    from datetime import datetime, timedelta, timezone

    rng, begin, limit = random.Random(9), datetime(2024, 1, 1, tzinfo=timezone.utc), 3000
    names = ["start", "utterance", "response", "spoken", "speech", "interrupt", "error", "stop", "utterance", "response", "spoken", "unknown"]
    rows = [(rng.randrange(3), begin + timedelta(milliseconds=400 * i), i, rng.choice(names)) for i in range(300)] + [(0, begin + timedelta(minutes=5), 300, "stop")]
    rows[0:2] = [(5, begin, 0, "start"), (5, begin + timedelta(milliseconds=400), 1, "utterance")]  # a plan that nothing follows
    found = run_twice(spark, tmp_path, [rows[i : i + 60] for i in range(0, 301, 60)], "key long, at timestamp, place long, event string", lambda x: turns.turns(x, "key", "at", "place", "event", limit), lambda out: (5, "timeout") in {(r[0], r[2]) for r in out} or pytest.fail("no timer"))
    want, states = [], {}
    for key, at, _, event in rows:
        state, since = states.get(key, ("idle", 0))
        state, since, out = turns.moved(state, since, round(at.timestamp() * 1000), event, limit)
        want += [(key, *r) for r in out]
        states[key] = state, since
    end = round(rows[-1][1].timestamp() * 1000) - 10_000
    want += [(key, since + limit, "timeout", "planning", "error", False) for key, (state, since) in states.items() if state == "planning" and since + limit < end]
    assert sorted(found) == sorted(want) and {r[2] for r in want} >= {"timeout", "speech", "error", "stop"} and any(r[5] for r in want)


def test_cache_of_a_stream(spark, tmp_path):
    """Hits, misses, expiry and eviction over micro-batches with a restart equal one pass over the prompts; the state shrinks when entries have lived their time, also of a model that is asked no more."""
    from datetime import datetime, timedelta, timezone

    rng, begin, options = random.Random(3), datetime(2024, 1, 1, tzinfo=timezone.utc), (0.99, 20_000, 6)
    rows = [(0 if i < 90 else rng.randrange(1, 3), begin + timedelta(milliseconds=700 * i), i, f"prompt {rng.randrange(40)}", None if rng.random() < 0.1 else [float(np.cos(a := rng.random() * 6)), float(np.sin(a))]) for i in range(240)]
    rows += [(1, begin + timedelta(minutes=60), 240, "late one", None), (1, begin + timedelta(minutes=61), 241, "last", None)]
    found = run_twice(spark, tmp_path, [rows[:60], rows[60:120], rows[120:180], rows[180:240], rows[240:241], rows[241:]], "model long, at timestamp, id long, prompt string, vector array<double>", lambda x: answers.cached(x, "model", "at", "id", "prompt", "vector", *options))
    held, want = {}, []
    for model, at, i, prompt, vector in rows:
        ms = round(at.timestamp() * 1000)
        kind, entry, score = answers.answer(held.setdefault(model, {}), prompt, i, ms, vector, *options)
        want.append((model, i, ms, kind, entry, score, len(held[model])))
    assert sorted(map(repr, found)) == sorted(map(repr, want))
    assert {r[3] for r in want} == {"exact", "similar", "miss"} and max(r[6] for r in want) == 6
    left = spark.read.format("statestore").option("stateVarName", "entries").load(str(tmp_path / "log")).collect()
    assert 1 <= len(left) <= 2 and all(r.key[0] == 1 for r in left)


def test_token_bucket_of_batch_and_stream(spark, tmp_path):
    rng = random.Random(3)
    rows = sorted((t, i % 3, i) for i, t in enumerate(rng.randrange(20_000) for _ in range(120)))
    want, state = {}, {}
    for t, user, i in rows:
        tokens, since = state.get(user, (4.0, t))
        whole = (t - since) // 1000
        tokens, since = (min(4, tokens + whole * 2), t) if whole else (tokens, since)
        want[i] = (tokens >= 1, tokens - (tokens >= 1))
        state[user] = (tokens - (tokens >= 1), since)
    df = spark.createDataFrame(rows, "at long, user long, i long")
    assert {r.i: (r.allowed, r.tokens) for r in logs.token_bucket(df, "user", "at", "i", 4, 2, 1000).collect()} == want
    found = streamed(spark, tmp_path, [rows[:50], rows[50:51], rows[51:]], df.schema, lambda s: limits.token_bucket(s, "user", "at", "i", 4, 2, 1000))
    assert {r[1]: (r[3], r[4]) for r in found} == want


def test_admitted_requests(spark):
    rng = random.Random(5)
    rows = sorted((rng.randrange(3000), i % 2, i) for i in range(150))
    want, past = {}, {}
    for t, user, i in rows:
        recent = [x for x in past.get(user, []) if t - x < 500]
        want[i] = len(recent) < 4
        past[user] = recent + [t] * want[i]
    df = spark.createDataFrame(rows, "at long, user long, i long")
    assert {r.i: r.allowed for r in logs.admitted(df, "user", "at", "i", 4, 500).collect()} == want


def test_voice_of_a_stream_keeps_state_and_marks_late_frames(spark, tmp_path):
    frames = [(1, t * 100, -20.0 if 5 <= t < 12 else -60.0) for t in range(30)]
    want = [(1, 700, "start", -20.0), (1, 2100, "end", -60.0)]
    batches = [frames[:7], frames[7:18], [(1, 100, -10.0)], frames[18:]]
    found = streamed(spark, tmp_path, batches, "stream long, at long, level double", lambda s: voice.voice_activity(s, "stream", "at", "level"))
    assert sorted(found) == sorted([*want, (1, 100, "late", -10.0)])


def test_an_open_chunk_is_joined_once(monkeypatch):
    calls, plain = [], chunking.joined
    monkeypatch.setattr(chunking, "joined", lambda parts, by: calls.append(len(parts)) or plain(parts, by))
    pieces = [chunking.Placed(f"word{i % 10} ", [(0, 6 * i)]) for i in range(400)]
    found = list(chunking.merged(pieces, 500, 50, 50))
    assert len(calls) <= 2 * len(found) + 1  # not once for each piece
    assert found[0].span()[0] == 0 and found[-1].span()[1] == 6 * 400 - 1 and all(b.span()[0] < a.span()[1] for a, b in zip(found, found[1:]))


def test_hashed_counts_equal_word_by_word():
    texts = ["One two one", "", "ONE  zwei\ndrei é", "   ", "two"]
    want = np.zeros((len(texts), 16), np.float32)
    for i, text in enumerate(texts):
        for word in text.lower().split():
            h = models.xxhash.xxh64_intdigest(word)
            want[i, (h >> 1) % 16] += 1 if h & 1 else -1
    want /= np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-12)
    found = models.hashing_embedding(texts, 16)
    assert found.dtype == np.float32 and (found == want).all() and models.hashing_embedding([], 16).shape == (0, 16)


def test_texts_are_files_under_their_names(spark, tmp_path):
    texts = {"a/b": "one\n---\ntwo", "_c.d é": "", None: "x\u0001"}
    rows = spark.createDataFrame(list(texts.items()), "key string, value string")
    assert [loaders.write_texts(rows, f"file:{tmp_path}/texts", "key", "value") for _ in range(2)] == [3, 3]  # a repeated write changes nothing
    assert {f.name: f.read_bytes().decode() for f in (tmp_path / "texts").iterdir()} == {"text-a%2Fb.txt": texts["a/b"], "text-_c.d%20%C3%A9.txt": "", "text.txt": texts[None]}
    assert sorted(r.text for r in loaders.load(spark, str(tmp_path / "texts"), "text", separator="---").collect()) == ["one", "two", "x\u0001"]


def test_load_text_leaves_out_a_blank_last_turn(spark, tmp_path):
    turns = [(1, 0, "user", "a --- b"), (1, 1, "assistant", " \n "), (2, 0, "user", "c"), (2, 1, "assistant", "d"), (None, 0, "user", "e"), (-3, 0, "user", " ")]
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    found = catalog.QUERIES["load_text"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, found), key=str) == [(1, 1, 1), (2, 2, 2), (None, 1, 1)]


def test_ingest_and_search_streams(spark, tmp_path):
    docs = [(i, f"document {i} " + " ".join(random.Random(i).choice(("apple", "pear", "plum", "fig")) + str(i % 7) for _ in range(20))) for i in range(30)]
    spark.createDataFrame(docs, "id long, text string").write.parquet(str(tmp_path / "docs"))
    source = spark.readStream.schema("id long, text string").parquet(str(tmp_path / "docs"))
    ingest.ingest_stream(source, str(tmp_path / "store"), str(tmp_path / "log")).awaitTermination()
    stored = spark.read.parquet(str(tmp_path / "store"))
    assert {r.id for r in stored.collect()} == set(range(30))
    spark.createDataFrame(docs[:3], "query_id long, text string").write.parquet(str(tmp_path / "queries"))
    queries = spark.readStream.schema("query_id long, text string").parquet(str(tmp_path / "queries"))
    search.search_stream(queries, stored, str(tmp_path / "found"), str(tmp_path / "log2"), k=1).awaitTermination()
    assert {(r.query_id, r.id) for r in spark.read.parquet(str(tmp_path / "found")).collect()} == {(0, 0), (1, 1), (2, 2)}
    found = search.semantic_search(stored, spark.createDataFrame([docs[5]], "query_id long, text string"), k=2, where=F.col("id") > 4, text_col="text").orderBy("rank").collect()
    assert found[0].id == 5 and found[0].text.startswith("document 5")


def test_slots(spark):
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 10, 57):
        cuts = sorted(rng.sample(range(200), n))
        found = spark.range(200).select("id", logs.slot_of(F.col("id"), cuts).alias("slot")).collect()
        assert all(r.slot == sum(c <= r.id for c in cuts) for r in found)


# ---- models ---------------------------------------------------------------------------------------------------------


def test_wrappers_of_embeddings(spark):
    seen = []

    def model(texts):
        seen.append(list(texts))
        return models.hashing_embedding(texts, 16)

    plain = models.hashing_embedding(["mail me at [EMAIL_REDACTED] now"], 16)[0]
    assert np.allclose(models.redacting(model)(["mail me at some.one@example.org now"])[0], plain)
    held = models.cached(2)(model)
    seen.clear()
    a = held(["x", "y", "x"])
    b = held(["y", "z", "x"])
    assert seen == [["x", "y"], ["z"]] and np.allclose(a[0], b[2]) and np.allclose(a[1], b[0])
    n = models.noisy(0.5)(model)
    assert np.allclose(n(["x", "y"])[1], n(["y"])[0]) and not np.allclose(n(["y"])[0], model(["y"])[0])
    df = spark.createDataFrame([("a@b.org wrote",), (None,), ("a@b.org wrote",)], "text string")
    out = [r.vector for r in models.embedded_once(df, models.embed(models.hashing_embedding, 32, 0, models.redacting)).collect()]
    assert sum(v is None for v in out) == 1 and len({tuple(v) for v in out if v}) == 1


def test_failing_models(spark):
    calls = []

    def flaky(texts):
        calls.append(1)
        if len(calls) % 2:
            raise ValueError("busy")
        return models.hashing_embedding(texts, 8)

    df = spark.createDataFrame([("a",), ("b",), (None,)], "text string").coalesce(1)
    assert [r[0] is None for r in df.select(models.embed(flaky, 1)(F.col("text"))).collect()] == [False, False, True]
    got = df.select(models.attempted(lambda t: str(1 // (t != "b")))(F.col("text")).alias("x")).collect()
    assert [(r.x.data, r.x.error) for r in got] == [("1", None), (None, "ZeroDivisionError: integer division or modulo by zero"), (None, None)]


def test_steps(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one two three. " * 60), (2, "four")], "id long, text string")
    run = ingest.pipeline(("chunk", ingest.chunk_step("recursive", size=100, overlap=10)), ("embed", ingest.embed_step()), ("mark", ingest.map_step("n", F.length)), ("store", ingest.store_step(str(tmp_path / "s"))))
    assert run(docs).count() > 8 and {"vector", "n", "start", "end"} <= set(run(docs).columns)
    with pytest.raises(RuntimeError, match=r"step 1 \(bad\)"):
        ingest.pipeline(ingest.chunk_step(), ("bad", lambda df: df.select("nothing")))(docs)
    given = spark.createDataFrame([(7, 0, "a chunk")], "id long, at int, text string")
    assert ingest.ingest_chunks(given).first().chunk_id == "chunk_7_0"
    rows = spark.createDataFrame([(1, "a", [1.0], "old"), (2, "b", [2.0], "new"), (3, "c", [3.0], None)], "id long, text string, vector array<float>, model string")
    out = {r.id: r for r in ingest.reindexed(rows, "new", models.embed(lambda t: np.full((len(t), 1), 9.0))).collect()}
    assert [out[i].vector[0] for i in (1, 2, 3)] == [9.0, 2.0, 9.0] and {r.model for r in out.values()} == {"new"}


# ---- texts ----------------------------------------------------------------------------------------------------------


def test_chunkers_keep_the_text(spark, data):
    squeeze = lambda t: "".join(t.split())
    texts = [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + ["", "x", "word " * 300, "a" * 1700, "A.\n\n\nB. C? D! E; f, g\n" * 60]
    for text in texts:
        for size, overlap in ((500, 50), (80, 0)):
            chunks = plain_chunks.recursive(text, size, overlap, 20)
            placed = [(x, a, b) for (x, _, _), (a, b) in plain_chunks.placed(text, ((c, "text", ()) for c in chunks), overlap)]
            assert all(len(x) <= size + overlap + 21 for x in chunks) and all(squeeze(text[a:b]) == squeeze(x) for x, a, b in placed)
            assert all(p[1] <= q[1] and q[1] - p[2] <= 200 for p, q in zip(placed, placed[1:]))
            if not overlap:
                assert "".join(map(squeeze, chunks)) == squeeze(text)
        blocks = list(plain_chunks._pack(plain_chunks.markdown_blocks(text), 300, 0))
        assert all(len(x) <= 321 for x, _, _ in blocks) and "".join(squeeze(x) for x, _, _ in blocks) == squeeze(text) or "#" in text


def chunk_texts(spark, data):
    """Texts of the tables and odd ones."""
    rng = random.Random(11)
    marks = ["# A", "## B b", "#", "- x", "1. y", "```", "~~~", "| a | b |", "> q", "", "  ", "\tword", "words and words " * 9, "ä. ö? ü! ", "x" * 700, "import os", "def f():", "    return 1", "class A:", "\u00a0"]
    mixed = ["\n".join(rng.choice(marks) for _ in range(rng.randrange(1, 40))) for _ in range(150)]
    odd = ["", " ", "\n\n", "x", "word " * 300, "a" * 1700, "\u00a0 lead and tail \u3000", "A.\n\n\nB. C? D! E; f, g\n" * 60, "tail " * 100 + "\n\n\n\n\nend", "😀 " * 400, "😀" * 1200]
    return [r.text for r in spark.read.parquet(f"{data}/documents.parquet").limit(60).collect()] + odd + mixed


def test_chunks_of_tables_equal_those_of_whole_texts(spark, data):
    """Every chunker against plain Python on whole texts; the parts of a document fall into many small batches."""
    texts = chunk_texts(spark, data)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    squeeze = lambda t: "".join(t.split())
    try:
        ways = [(chunking.recursive_chunks(size, overlap, least), lambda t, a=(size, overlap, least): [(x, "text", ()) for x in plain_chunks.recursive(t, *a)]) for size, overlap, least in ((500, 50, 50), (80, 0, 20), (60, 30, 0))]
        ways += [(chunking.markdown_chunks(300, least), lambda t, least=least: list(plain_chunks._pack(plain_chunks.markdown_blocks(t), 300, least))) for least in (0, 50)]
        ways.append((chunking.code_chunks("python", 300, 0), lambda t: list(plain_chunks._pack(plain_chunks.code_blocks(t, "python"), 300, 0))))
        for how, plain in ways:
            got = {}
            for r in sorted(chunking.chunked(docs, how).collect(), key=lambda r: (r.id, r.at)):
                got.setdefault(r.id, []).append((r.text, r.kind, tuple(r.path)))
                place, own = squeeze(texts[r.id][r.start : r.end]), squeeze(r.text)
                assert r.at == len(got[r.id]) - 1 and (place == own or how.gap and (place[:1], place[-1:]) == (own[:1], own[-1:]))  # Markdown's headers stand between lines and in no chunk
            assert got == {i: found for i, t in enumerate(texts) if (found := plain(t))}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chunks_of_odd_tables(spark):
    same = spark.createDataFrame([("a", "one", 1), ("a", "one", 1), ("a", "two", 2), (None, "three", 3)], "id string, text string, kind int").coalesce(1)
    assert sorted((r.chunk_id, r.id, r.at, r.text) for r in chunking.chunked(same, chunking.recursive_chunks()).where("id IS NOT NULL").collect()) == [("chunk_a_0", "a", 0, "one"), ("chunk_a_0", "a", 0, "one"), ("chunk_a_0", "a", 0, "two")]
    assert chunking.chunked(same, chunking.markdown_chunks(least=0)).count() == 4 and chunking.chunked(same.limit(0), chunking.markdown_chunks()).count() == 0
    long = spark.range(1).select("id", F.expr("repeat('some words. ', 400000)").alias("text"))
    found = chunking.chunked(long, chunking.recursive_chunks(500, 0)).agg(F.count("*").alias("n"), F.max("end").alias("end"), F.max(F.length("text")).alias("longest")).first()
    assert found.end == 4_799_999 and found.longest <= 551 and found.n == 9_756
    own = lambda t: F.array(F.struct(F.lit(0).alias("at"), F.upper(t).alias("text"), F.lit(0).alias("start"), F.length(t).alias("end"), F.lit("own").alias("kind"), F.array().cast("array<string>").alias("path")))
    assert [r.text for r in chunking.chunked(same.limit(1), own).collect()] == ["ONE"]


def test_markdown_and_code_chunks(spark):
    text = "# Top\nintro words\n\n## Sub\n- one\n- two\n\n```py\nx = 1\n\n# no header\n```\n| a | b |\n|---|---|\n> said\n# Next\nend"
    found = [(kind, list(path), x) for x, kind, path in plain_chunks._pack(plain_chunks.markdown_blocks(text), 300, 0)]
    assert found == [("text", ["Top"], "intro words"), ("list", ["Top", "Sub"], "- one\n- two"), ("fence", ["Top", "Sub"], "```py\nx = 1\n\n# no header\n```"), ("table", ["Top", "Sub"], "| a | b |\n|---|---|"), ("quote", ["Top", "Sub"], "> said"), ("text", ["Next"], "end")]
    code = "import os\nimport sys\n\nX = 1\n\ndef f():\n    return 1\n\nclass A:\n    def g(self):\n        pass\n"
    kinds = [(kind, path) for _, kind, path in plain_chunks.code_blocks(code, "python")]
    assert kinds == [("import", ()), ("code", ()), ("definition", ("def f():",)), ("definition", ("class A:",))]
    texts = {"def f():\n    import os\n": "python", "fn main() { let x = 1; }": "rust", "package a\nclass B {}": "java", "package a\nfun b() {}": "kotlin", "plain words": "generic", "import React from 'x'\nconst a = 1": "javascript", "import React\ninterface A { b: string }": "typescript", "\n" * 60 + "def f()": "python", "#include <a>": "cpp", "require 'x'\nend": "ruby"}
    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    assert [r[0] for r in df.select(chunking.code_language(F.col("t"))).collect()] == [*texts.values(), None]
    rows = chunking.chunked(spark.createDataFrame([(1, code)], "id long, text string"), chunking.code_chunks("python", least=0, with_imports=True)).orderBy("at").collect()
    assert rows[2].text == "import os\nimport sys\n\ndef f():\n    return 1" and code[rows[2].start : rows[2].end] == "def f():\n    return 1"
    for strategy in ("recursive", "sentence", "paragraph", "semantic", "markdown"):
        assert spark.createDataFrame([(1, "words " * 200)], "id long, text string").transform(lambda d, s=strategy: chunking.chunked(d, chunking.chunker(s))).count() >= 1
    with pytest.raises(ValueError):
        chunking.chunker("other")


def test_clauses():
    text = "Dr. Who met Mr. Smith at 3.14 p.m. in the U.S. on Monday. Did he? Yes! " + "this goes on, and on " * 12 + "to the end."
    parts = chunking.clauses(text)
    assert " ".join(parts) == " ".join(text.split()) and all(4 <= len(p.split()) <= 28 for p in parts) and parts[0].endswith("Monday.")
    assert chunking.clauses("") == [] and chunking.clauses("Short.") == ["Short."]


def test_json_repair():
    whole = '{"a": [1, {"b": "x\\"y"}, true], "c": {"d": null}, "e": "end"}'
    for cut in range(1, len(whole) + 1):
        json.loads(jsontext.repaired(whole[:cut]))
    assert jsontext.repaired('{"a": [1, 2') == '{"a":[1,2]}' and jsontext.repaired('{"a": "unfin') == '{"a":"unfin"}' and jsontext.repaired('{"a": 1, "b') == '{"a":1}' and jsontext.repaired('{"a": 1, "b": ') == '{"a":1}'
    assert jsontext.repaired("no json") is None and jsontext.repaired("") is None and jsontext.repaired('{"a": 1} and more') == '{"a":1}' and jsontext.repaired('["x\\u12') == '["x"]'
    long = '{"k": [' + "1, " * 200_000
    assert len(jsontext.repaired(long)) > 390_000


def test_common_subsequences_and_bleu(spark):
    rng = random.Random(7)

    def table(a, b):
        d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                d[i + 1][j + 1] = d[i][j] + 1 if x == y else max(d[i][j + 1], d[i + 1][j])
        return d[-1][-1]

    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randint(0, 30))] for _ in range(2))
        assert metrics.common_length(a, b) == table(a, b)
    pairs = spark.createDataFrame([(1, "the cat sat on the mat", "the cat sat on the mat"), (2, "a b c d", "b x c y d z"), (3, "", "words"), (4, "x", "y")], "pair_id int, candidate string, reference string")
    assert [round(r.rouge, 6) for r in metrics.rouge_l(pairs).orderBy("pair_id").collect()] == [1.0, 0.6, 0.0, 0.0]
    many = spark.createDataFrame([(1, "the cat sat on the mat", ["no match here", "the cat sat on the mat"]), (2, "the cat", ["the cat sat on the mat"]), (3, "", ["x"])], "pair_id int, candidate string, references array<string>")
    assert [r.bleu for r in metrics.bleu(many).orderBy("pair_id").collect()] == [1.0, 0.0, 0.0]


def test_ages_sizes_and_finds(spark):
    df = spark.createDataFrame([("30d",), ("1.5h",), ("2M",), ("1y",), ("x",), ("3 w",), (None,)], "t string")
    assert [r[0] for r in df.select(X.parse_age(F.col("t"))).collect()] == [2_592_000_000.0, 5_400_000.0, 5_184_000_000.0, 31_536_000_000.0, None, 1_814_400_000.0, None]
    assert [r[0] for r in df.select(X.parse_quota_age(F.col("t"))).collect()] == [2_592_000_000, None, 120_000, None, None, 1_814_400_000, None]
    sizes = spark.createDataFrame([(0,), (1023,), (1536,), (1048576,), (5 * 1024**3,)], "n long")
    assert [tuple(r) for r in sizes.select(X.format_bytes(F.col("n")), X.format_duration(F.col("n"))).collect()] == [("0 B", "0ms"), ("1023 B", "1.0s"), ("1.5 KB", "1.5s"), ("1 MB", "17.5m"), ("5 GB", "62.1d")]
    text = "mail a.b@c.org or 555-123-4567, ssn 123-45-6789"
    found = spark.createDataFrame([(text,), (None,)], "t string").select(X.find_pii("t").alias("m")).collect()
    assert all(text[m.start : m.end] == m.value for m in found[0].m) and {"email", "phone", "ssn"} <= {m.kind for m in found[0].m} and found[1].m == []
    assert X.redact_plain(text) == spark.createDataFrame([(text,)], "t string").select(X.redact(F.col("t"))).first()[0]


# ---- files ----------------------------------------------------------------------------------------------------------


def test_loaders_are_chosen(spark, tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    csv = write("a.csv", 'id,title,text\n1,T,"with ""quotes"", and\nlines"\n2,U,\n')
    js = write("b", '{"items": [{"id": "x", "by": {"name": "N"}, "body": "B", "n": 3}, {"id": "y", "title": "only"}]}')
    page = write("c.html", '<html><head><title>A &amp; B</title><meta name="author" content="me"></head><body><nav>x</nav><p>One</p><p>Two</p></body></html>')
    plain = write("d.txt", "one\n---\n two \n---\n\n")
    assert [loaders.detected(spark, p) for p in (csv, js, page, plain)] == ["csv", "json", "html", "text"]
    assert [(r.id, r.text, r.metadata["title"]) for r in loaders.load(spark, csv, id_column="id").collect()] == [("1", 'with "quotes", and\nlines', "T")]
    assert loaders.load(spark, csv, "csv", id_column="id", skip_empty=False).count() == 2
    assert [(r.id, r.text, r.metadata.get("n")) for r in loaders.load(spark, js, records="items").collect()] == [("x", "B", "3"), ("y", "only", None)]
    assert [sorted(r.text.split()) for r in loaders.load(spark, js, "json", records="items", all_strings=True).collect()] == [["B", "N", "x"], ["only", "y"]]
    row = loaders.load(spark, page).first()
    assert row.metadata == {"author": "me", "title": "A &amp; B"} and row.text.endswith("One Two") and row.id == "a-amp-b"
    assert [(r.text, r.metadata["totalParts"]) for r in loaders.load(spark, plain, separator="---").collect()] == [("one", "2"), ("two", "2")]
    own = lambda spark_, paths: spark_.createDataFrame([("i", "t", paths, {})], "id string, text string, source string, metadata map<string,string>")
    assert loaders.load_all(spark, [(plain, None), (page, "html"), ("p", own)]).count() == 3
    with pytest.raises(ValueError):
        loaders.load(spark, plain, "pdf")


def test_formats_are_detected(spark, tmp_path):
    heads = {'{"vectors": [{"id": "a", "values": [1]}]}': "nested", '{"ids": ["a"], "embeddings": [[1]]}': "parallel", '{"id": "a", "vector": [1]}\n{"id": "b"}': "jsonl", "id,text,vector\na,b,[1]": "csv", "just words": None}
    for head, form in heads.items():
        assert formats.detect_format(head) == form
    (tmp_path / "v.csv").write_text('id,text,vector,source\nv1,hello,"[0.1, 0.2]",s\nv2,"a, b","[1,2]",7\n')
    rows = {r.id: r for r in formats.read_vectors(spark, str(tmp_path / "v.csv")).collect()}
    assert rows["v2"].text == "a, b" and rows["v1"].vector == [0.1, 0.2] and rows["v2"].metadata == {"source": "7"}


def test_collections(spark):
    t = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "z")], "collection_id string, id long, note string")
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(collections.cleared(t, "a")) == [("b", 1, "z")]
    twice = spark.createDataFrame([("a", 1, "p"), ("a", 1, "q")], "collection_id string, id long, note string")
    assert rows(collections.upserted(t, twice)) == rows(collections.upserted(t, twice.repartition(3).orderBy(F.desc("note"))))
    nulls = spark.createDataFrame([("a", 1, None)], "collection_id string, id long, note string")
    assert rows(collections.updated(t, nulls))[0] == ("a", 1, "x") and rows(collections.updated(t, nulls, set_nulls=True))[0] == ("a", 1, None)
    seen, obs = logs.logged(t, "rows seen")
    seen.collect()
    assert obs.get == {"rows": 3}


def test_cache_answers(spark):
    from heron.operators import cache

    entries = spark.createDataFrame([("e1", "hello", "m", [1.0, 0.0], 0, 5, "hi"), ("e2", "bye", "m", [0.0, 1.0], 0, 9, "ciao")], "entry_id string, key string, model_id string, vector array<float>, created_ms long, accessed_ms long, response string")
    prompts = spark.createDataFrame([(1, "hello", "m", [1.0, 0.0], 50, "hello"), (2, "hello!", "m", [0.99, 0.05], 60, "hello!"), (3, "other", "m", [0.7, 0.7], 50, "other"), (4, "bye", "m", [0.0, 1.0], 5000, "bye"), (5, "hello", "n", [1.0, 0.0], 50, "hello")], "prompt_id long, key string, model_id string, vector array<float>, asked_ms long, text string")
    found = cache.lookup(entries, prompts, ttl_ms=1000)
    assert {r.prompt_id: (r.entry_id, r.kind) for r in found.collect()} == {1: ("e1", "exact"), 2: ("e1", "similar"), 3: (None, None), 4: (None, None), 5: (None, None)}
    out = {r.prompt_id: (r.response, r.cached) for r in cache.answered(prompts, entries, F.upper, ttl_ms=1000).collect()}
    assert out == {1: ("hi", True), 2: ("hi", True), 3: ("OTHER", False), 4: ("BYE", False), 5: ("HELLO", False)}
    assert {r.entry_id: r.accessed_ms for r in cache.touched(entries, found, prompts).collect()} == {"e1": 60, "e2": 9}
    assert [r.entry_id for r in cache.evicted(entries, 1).collect()] == ["e1"]
    none = cache.lookup(entries.limit(0), prompts)
    assert none.count() == 5 and cache.stats(entries.limit(0), none).first().hit_rate == 0


def test_median_by_ranges(spark):
    for values in ([], [3.0], [1.0, 2.0], [5.0, 1.0, 1.0, None], [float(i * 7919 % 1000) for i in range(3001)], [1.0] * 50 + [9.0] * 50):
        rows = spark.createDataFrame([(x,) for x in values], "x double")
        assert ranges.median(rows, "x").collect() == rows.agg(F.percentile("x", 0.5).alias("median")).collect()


def test_rows_of_a_key_come_in_steps():
    """Sorted over all frames, a few at a time; equal ones keep their order, and missing values stay."""
    frames = [pd.DataFrame({"at_ms": [5, 1], "prompt": ["a", "b"], "vector": [[1.0, 2.0], None]}), pd.DataFrame({"at_ms": [3, 1, 5], "prompt": ["c", "d", "e"], "vector": [None, None, np.array([0.5])]})]
    steps = list(turns.in_order(iter(frames), {"at_ms": pa.int64(), "prompt": pa.large_string(), "vector": pa.large_list(pa.float64())}, "at_ms", step=2))
    assert [len(x) for x in steps] == [2, 2, 1]
    assert [x for step in steps for x in step] == [(1, "b", None), (1, "d", None), (3, "c", None), (5, "a", [1.0, 2.0]), (5, "e", [0.5])]


def test_utterances_of_a_table_hold_no_whole_key(spark, monkeypatch):
    """Batches of three frames give the rows of one pass, also where a key is null and where keys meet in a batch."""
    frames = [(k, i * 100, -20.0 if i // 30 % 2 == 0 else -60.0) for k in (None, 1, 2) for i in range(200)]
    rows = spark.createDataFrame(frames, "stream int, at long, level double").withColumn("at", F.timestamp_millis("at")).repartition(5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        out = turns.utterances_of(rows, "stream", "at", "level")
        got = sorted((tuple(r) for r in out.collect()), key=str)
        assert "FlatMapGroups" not in out._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = [(k, *r) for k in (None, 1, 2) for r in turns.heard(turns.Voice(), turns.Utterance(), iter([f[1:] for f in frames if f[0] == k]), turns.Listening())[2]]
    assert got == sorted(want, key=str) and len(got) > 9


def test_postings_are_folded_from_sorted_rows():
    """Runs that batches break are one posting row each, with the shortest document of each count; words of documents are counted."""
    rows = [(0, t, w, i, 1 + i % 3, 10 - i) for t in ("a", "b") for w in (0, 2) for i in range(5)] + [(1, "c", 2, 9, 1, 4)]
    columns = ["bucket", "term", "window", "id", "tf", "dl"]
    kinds = [pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32()]
    whole = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=columns)
    want = {}
    for b, t, w, *p in rows:
        want.setdefault((b, t, w), []).append(dict(zip(("id", "tf", "dl"), p)))
    for size in (1, 2, 7, len(rows)):
        got = [r for x in segments._blocks(whole.slice(i, size) for i in range(0, len(rows), size)) for r in x.to_pylist()]
        assert [((r["bucket"], r["term"], r["window"]), r["postings"]) for r in got] == list(want.items())
        assert all(r["n"] == len(r["postings"]) and {x["tf"]: x["dl"] for x in r["top"]} == {p["tf"]: min(q["dl"] for q in r["postings"] if q["tf"] == p["tf"]) for p in r["postings"]} for r in got)
    docs = pa.RecordBatch.from_arrays([pa.array([1, 2, 3]), pa.array([4, 0, 1], pa.int32()), pa.array([["b", "a", "b", "\u00e9"], [], ["a"]], pa.list_(pa.string()))], names=["id", "dl", "words"])
    assert [r["terms"] for x in segments._counted(iter([docs, docs.slice(1, 1)])) for r in x.to_pylist()] == [[{"term": "a", "tf": 1}, {"term": "b", "tf": 2}, {"term": "\u00e9", "tf": 1}], [], [{"term": "a", "tf": 1}], []]


def test_postings_are_made_in_bounded_parts(spark, tmp_path, monkeypatch):
    """Documents that stand together are a window, of which none has more than its size; parts of a few postings give what whole batches give."""
    rng, size = random.Random(9), 4
    docs = [(i, [{"term": t, "tf": rng.randint(1, 3)} for t in sorted(rng.sample("abcdefgh", rng.randint(0, 8)))]) for i in range(50)]
    kind = pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))
    whole = pa.RecordBatch.from_arrays([pa.array([i for i, _ in docs]), pa.array([sum(t["tf"] for t in x) for _, x in docs], pa.int32()), pa.array([x for _, x in docs], kind)], names=["id", "dl", "terms"])
    want = {}
    for i, terms in docs:
        for t in terms:
            want.setdefault((t["term"], 7 + i // size), []).append({"id": i, "tf": t["tf"], "dl": sum(x["tf"] for x in terms)})
    for most in (1, 20, 1 << 18):
        monkeypatch.setattr(segments, "SORTED", most)
        rows = list(segments._postings(iter([whole.slice(0, 20), whole.slice(20)]), size, 7))
        assert all(x.num_rows <= max(most, 8 * size) for x in rows)
        got = [r for x in segments._blocks(iter(rows)) for r in x.to_pylist()]
        assert {(r["term"], r["window"]): r["postings"] for r in got} == want and len(got) == len(want)
        words = pa.RecordBatch.from_arrays([whole["id"], whole["dl"], pa.array([[t["term"] for t in x for _ in range(t["tf"])] for _, x in docs], pa.list_(pa.string()))], names=["id", "dl", "words"])
        counted = list(segments._counted(iter([words])))
        assert [x for b in counted for x in b["terms"].to_pylist()] == [x for _, x in docs] and (len(counted) > 1) == (most < 100)
    store = segments.Store(spark, str(tmp_path / "s"), window=8, buckets=2)
    store.add(spark.createDataFrame([(i, f"the word{i}") for i in range(200)], "id long, text string"))
    the = store.read("postings", [store.version().segments[0]["name"]]).where("term = 'the'").collect()
    assert all(r.n == len(r.postings) <= 8 for r in the) and sorted(p.id for r in the for p in r.postings) == list(range(200)) and len({r.window for r in the}) == len(the)
