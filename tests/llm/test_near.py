"""Near-duplicate documents and lines against brute force."""

import random
import re
import time

import numpy as np
import pytest

from heron.llm import op08_line_dedup as lines
from heron.llm import op09_near_dedup as near
from heron.llm.common import components, forest, group_links, word_hashes

WORDS = [f"w{i}" for i in range(400)]


def shingle_set(text, k):
    words = re.findall(r"[^ \t-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} - {()}


def groups(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and linked(i, j):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: find(i) for i in ids}


def brute_near(rows, k, percent):
    sets = {i: shingle_set(t, k) for i, t in rows}
    comp = groups(list(sets), lambda a, b: bool(sets[a] and sets[b]) and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]))
    return {i: (len(sets[i]), comp[i], comp[i] == i) for i in sets}


def near_rows(seed=3):
    rng, rows = random.Random(seed), []
    for _ in range(20):
        base = [rng.choice(WORDS) for _ in range(rng.randint(3, 200))]
        rows.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                copy[rng.randrange(len(copy))] = rng.choice(WORDS)
            rows.append(rng.choice([" ", "\n", "\t "]).join(copy).upper())
    rows += ["", None, "   ", "one", "ONE", "one two", "one two", "Ünï cödé words here", "ünï cödé words here"]
    rng.shuffle(rows)
    return [(i * 7, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("k,percent", [(3, 85), (5, 80)])
def test_near_duplicates_equal_brute_force(spark, k, percent):
    rows = near_rows()
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k, percent=percent).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_near(rows, k, percent)


def test_near_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(near, "SKETCH_BLOCK", 3), monkeypatch.setattr(near, "SET_BLOCK", 3)
    rows = near_rows(5)
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=3, percent=85).collect()
    assert {r.id: r.component_id for r in found} == {i: v[1] for i, v in brute_near(rows, 3, 85).items()}


def test_documents_table(spark, data):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()]
    found = near.query(spark, data).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_near(rows, 3, 85)


def test_sketch_estimates_high_similarity():
    import numpy as np

    m, salts = near.constants(near.ROWS * near.BANDS, 11), near.constants(near.ROWS * near.BANDS, 13)
    rng = np.random.default_rng(1)
    for share in (0.8, 0.9, 0.97):
        errors = []
        for _ in range(30):
            pool = rng.integers(0, 1 << 63, 2000).astype(np.uint64)
            n = round(1000 * share)
            a, b = np.unique(pool[:1000]), np.unique(np.concatenate([pool[:n], pool[1000 : 2000 - n]]))
            j = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
            x, y = (int.from_bytes(near.odd_sketch(near.signature(s, m), salts)) for s in (a, b))
            bits = (x ^ y).bit_count()
            assert bits <= near.most_bits(j)
            errors.append(near.sketch_similarity(bits) - j)
        assert abs(sum(errors) / len(errors)) < 0.03


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (103, 101), (200, 200)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("family", [0.0, 0.5, 0.95])
def test_group_links_join_what_all_pairs_join(spark, family):
    """Groups of numbers on a circle, linked if close by; a part of a group is one family around zero."""
    rng = random.Random(int(family * 100))
    rows = [(g, g * 1000 + i, rng.uniform(0, 0.01) if rng.random() < family else rng.uniform(0, 1)) for g, n in enumerate((1, 2, 9, 60, 150)) for i in range(n)]
    linked = lambda x, y: abs(x - y) < 0.012

    def verify(columns, in_a, in_b, classes):
        assert len(in_a) <= 60  # two blocks of about 20
        x = columns[0]
        return forest(in_a, in_b, classes, lambda a: abs(np.array(x) - x[a]) < 0.02, lambda a, b: linked(x[a], x[b]))

    found = components(group_links(spark.createDataFrame(rows, "group long, node long, x double"), ["x"], verify, 20)).collect()
    where = {n: (g, x) for g, n, x in rows}
    want = groups(list(where), lambda a, b: where[a][0] == where[b][0] and linked(where[a][1], where[b][1]))
    assert {n: c for n, c in want.items() if sum(v == c for v in want.values()) > 1} == {r.node: r.component for r in found}


def test_string_ids(spark):
    rows = [(f"id {i:04d}", t) for i, t in near_rows()]
    found = near.near_duplicates(spark.createDataFrame(rows, "doc_id string, text string"), k=3, percent=85).collect()
    assert {r.id: (r.n_shingles, r.component_id, r.kept) for r in found} == brute_near(rows, 3, 85)


def test_shingles_of_long_texts_in_parts():
    text = (" ".join(f"w{i % 77}x{i}" for i in range(3000)) + "\t\n " + "y" * 5000 + " end").encode()
    data = np.frombuffer(text, np.uint8)
    whole = word_hashes(data, np.array([0, len(data)]))[0]
    for most in (1, 100, 7777):
        part, first = word_hashes(data, np.array([0, len(data)]), most)
        assert part.tolist() == whole.tolist() and first.tolist() == [0, len(whole)]


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_within_and_probes():
    rng = random.Random(1)
    for _ in range(4000):
        e = rng.choice([1, 2, 3])
        a = "".join(rng.choice("abcé") for _ in range(rng.randint(0, 40)))
        b = list(a)
        for _ in range(rng.randint(0, 4)):
            i = rng.randint(0, len(b))
            b[i : i + rng.randint(0, 1)] = rng.choice(["", "a", "é"])
        b = "".join(b)
        d = distance(a, b)
        assert lines.within(a, b, e) == (d <= e)
        if d <= e and min(len(a), len(b)) > e:
            short, long = sorted((a, b), key=len)
            index = {(len(short), i, short[p : p + n]) for i, (p, n) in enumerate(lines.segments(len(short), e))}
            assert any((length, i, long[p : p + n]) in index for length, i, p, n in lines.probes(len(long), e, 0))


def test_within_long_lines():
    rng = random.Random(2)
    a = "".join(rng.choice("abcd") for _ in range(200_000))
    for cut in (0, 1, 2, 3):
        b = a[:100] + "z" + a[100 + cut : 150_000] + "y" + a[150_001:]
        began = time.time()
        assert lines.within(a, b, 2) == (cut < 2) and lines.within(b, a, 3) == (cut < 3) and time.time() - began < 5


def test_large_signatures_are_dealt_anew(spark, monkeypatch):
    """Many lines share a beginning; some pairs of them are near each other."""
    monkeypatch.setattr(lines, "BLOCK", 8)
    dealt, anew = [], lines.dealt_anew
    monkeypatch.setattr(lines, "dealt_anew", lambda *given: dealt.append(1) or anew(*given))
    rng = random.Random(11)
    ends = ["".join(rng.choice("abcdefgh") for _ in range(24)) for _ in range(60)]
    ends += [x[:3] + "z" + x[4:] for x in ends[:10]] + [x[:20] + x[21:] + "y" for x in ends[10:20]] + ["abab" * 6, "baba" * 6]
    rows = [(i, "the same words, " + x) for i, x in enumerate(ends)]
    found = lines.line_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, r.at): (r.class_id, r.class_at, r.n_class, r.kept) for r in found} == brute_lines(rows, lines.EDITS, lines.CHARS) and dealt


def brute_lines(rows, edits, chars):
    places = [(i, at, x) for i, t in rows if t is not None for at, x in enumerate(t.split("\n"))]
    texts = sorted({x for _, _, x in places if x})

    def linked(a, b):
        most = min(edits, min(len(texts[a]), len(texts[b])) // chars)
        return abs(len(texts[a]) - len(texts[b])) <= most and distance(texts[a], texts[b]) <= most

    comp = groups(range(len(texts)), linked)
    of = {texts[i]: c for i, c in comp.items()}
    classes = {}
    for i, at, x in sorted(places):
        if x in of:
            classes.setdefault(of[x], []).append((i, at))
    return {(i, at): (*classes[of[x]][0], len(classes[of[x]]), classes[of[x]][0] == (i, at)) if x in of else (i, at, 1, True) for i, at, x in places}


def line_rows():
    rng, rows = random.Random(9), []
    bases = ["".join(rng.choice("abcdefgh éñ") for _ in range(rng.randint(8, 90))) for _ in range(30)]
    for i in range(60):
        out = []
        for _ in range(rng.randint(0, 5)):
            x = list(rng.choice(bases))
            for _ in range(rng.choice([0, 0, 1, 2, 3])):
                j = rng.randrange(len(x))
                x[j : j + rng.randint(0, 1)] = rng.choice(["", "z", "é"])
            out.append("".join(x))
        rows.append((i, "\n".join(out)))
    return rows + [(98, None), (99, ""), (97, "\n\n")]


@pytest.mark.parametrize("block", [512, 3])
def test_line_duplicates_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(lines, "BLOCK", block)
    rows = line_rows()
    found = lines.line_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.id, r.at): (r.class_id, r.class_at, r.n_class, r.kept) for r in found} == brute_lines(rows, lines.EDITS, lines.CHARS)


def test_line_dedup_rewrites(spark):
    rows = line_rows()
    keep = {k for k, v in brute_lines(rows, lines.EDITS, lines.CHARS).items() if v[3]}
    want = {}
    for i, t in rows:
        if t is None:
            want[i] = None
        elif left := [x for at, x in enumerate(t.split("\n")) if (i, at) in keep]:
            want[i] = "\n".join(left)
    docs = spark.createDataFrame([(i, t, "en", "s", 0 if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = lines.deduplicated(docs)
    assert out.columns == docs.columns
    got = out.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text or "") for r in got)


def test_line_query_classes_short_lines(spark, tmp_path):
    """Short lines by equality, those of a few words by one edit, longer ones by two; at the bounds and across them."""
    rng = random.Random(6)
    ends = ["".join(rng.choice("abcdefgh") for _ in range(n)) for n in (1, 10, 11, 12, 13, 22, 23, 24, 25) for _ in range(3)]
    changed = [x[: len(x) // 2] + rng.choice(("", "X", "XY", "é")) + x[len(x) // 2 + rng.randint(0, 2) :] for x in ends * 4]
    rows = line_rows() + [(200 + i, f"Read more\n\nShare this page\nown {i}\nRead  more") for i in range(4)] + [(300 + i, x) for i, x in enumerate(ends + changed)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = {(r.doc_id, r.line): (r.class_doc, r.class_line, r.n_class, r.kept) for r in lines.query(spark, str(tmp_path)).collect()}
    assert found == brute_lines(rows, lines.EDITS, lines.CHARS)
    assert found[203, 0] == (200, 0, 4, False) and found[203, 2] == (200, 2, 4, False) and found[203, 1] == (203, 1, 1, True) and found[203, 3][3]
