"""Merkle manifest, filter audit and exact dedup against brute force in plain Python, on odd tables and hot groups."""

import hashlib
import random
import re
import zlib
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from heron.llm import op11_merkle, op12_filter_audit, op13_exact_dedup

from tests.llm.test_operators import ODD, SCHEMA, clashing, empty, odd

LABELS = "doc_id long, quality int, toxic int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def table_of(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def mixed_rows(n, seed=1):
    """Documents of hot and rare sources, with copies, line feeds, capitals, marks and nulls."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        words = [rng.choice(["alpha", "Beta", "GAMMA", "delta", "été", "x&y", "😀"]) if rng.random() < 0.4 else f"w{rng.randrange(900)}" for _ in range(rng.choice((0, 3, 150, 250, 700)))]
        text = "".join(w + rng.choice((" ", " ", "\n", "\t ", "  ")) for w in words)
        if out and rng.random() < 0.4:
            text = rng.choice(out)[1]
        if text and rng.random() < 0.1:
            text = text.replace(" ", "\x0b\x0c", 3)
        out.append((i * 7 % n, None if rng.random() < 0.05 else text, rng.choice(("en", "fr", None, "")), rng.choice(("hot", "hot", "hot", "é", "Z", "", None, f"s{i}")), rng.choice((None, i))))
    return out


def brute_manifest(rows, fanout=3):
    def leaf(r, text):
        values = [r[0], r[3], r[2], r[4], text]
        return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def tree(digests):
        levels = [digests]
        while len(levels[-1]) > 1:
            levels.append([H(*levels[-1][i : i + fanout]) for i in range(0, len(levels[-1]), fanout)])
        return levels

    def climb(levels, at, node):
        siblings = []
        for level in levels[:-1]:
            start = at - at % fanout
            run = level[start : start + fanout]
            siblings += [x for k, x in enumerate(run) if k != at - start]
            run[at - start] = node
            node, at = H(*run), at // fanout
        return node, siblings

    groups = {}
    for r in rows:
        groups.setdefault(r[3], []).append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([d for _, d in sorted((r[0], leaf(r, r[1])) for r in groups[s])]) for s in names}
    above = tree([trees[s][-1][0] for s in names])
    out = []
    for s in names:
        for at, r in enumerate(sorted(groups[s], key=lambda r: (r[0], leaf(r, r[1])))):
            tampered = leaf(r, r[1].replace("\n", "") if r[1] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 else r[1])
            node, one = climb(trees[s], at, tampered)
            node, two = climb(above, names.index(s), node)
            out.append((r[0], leaf(r, r[1]), trees[s][-1][0], above[-1][0], H(*one, *two), node, node == above[-1][0]))
    return out


@pytest.mark.parametrize("n", (1, 2, 9, 200))
def test_manifest_equals_brute_force(spark, n):
    rows = mixed_rows(n)
    found = op11_merkle.audited(table_of(spark, rows).repartition(3)).drop("path")
    found = found.select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found)) == sorted(brute_manifest(rows))
    assert n < 9 or {r.verified for r in found} == {True, False}


def test_manifest_of_single_rows_and_levels_in_many_tasks(spark, monkeypatch):
    monkeypatch.setattr(op11_merkle, "FEW", 5)
    rows = [(i, f"text\n{i}", "en", f"s{i:03}" if i % 2 else "hot", i) for i in range(120)]
    found = op11_merkle.audited(table_of(spark, rows)).select("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted(map(tuple, found)) == sorted(brute_manifest(rows))
    assert all(r.subroot == r.leaf for r in found if r.id % 2)


def test_manifest_shows_any_change(spark):
    rows = mixed_rows(60, 3)
    first = {r.id: r for r in op11_merkle.audited(table_of(spark, rows)).collect()}
    at = next(i for i, r in enumerate(rows) if r[1])
    rows[at] = (*rows[at][:1], rows[at][1] + "!", *rows[at][2:])
    second = {r.id: r for r in op11_merkle.audited(table_of(spark, rows)).collect()}
    changed = rows[at][0]
    assert {i for i in first if first[i].leaf != second[i].leaf} == {changed} and first[changed].root != second[changed].root
    same = {r[0] for r in rows if r[3] != rows[at][3]}
    assert all(first[i].subroot == second[i].subroot for i in same) and first[changed].subroot != second[changed].subroot


def brute_audit(rows, labels):
    texts = [(r[0], r[1] or "", r[2] or "") for r in rows]
    good, toxic = {i for i, q, _ in labels if q == 1}, {i for i, _, t in labels if t == 1}
    docs = []
    for i, text, part in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text), "D": bool(re.search(r"[#$%&*|]", text))}
        fails["E"] = i is not None and any(j is not None and j < i and t == text for j, t, _ in texts)
        docs.append((part, fails, i in good, i in toxic))
    out = []
    for part in {p for p, *_ in docs}:
        mine = [d for d in docs if d[0] == part]
        shapley, steps = dict.fromkeys("ABCDE", 0), []
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, f in enumerate(order, 1):
                lost = [d for d in left if d[1][f]]
                left = [d for d in left if not d[1][f]]
                shapley[f] += len(lost)
                steps.append((part, order, k, f, len(left), len(lost), sum(d[1][f] for d in mine) - len(lost), sum(d[1][f] and sum(d[1].values()) == 1 for d in mine), sum(d[2] for d in lost), sum(d[3] for d in lost)))
        out += [(*s, shapley[s[3]]) for s in steps]
    return out


COLUMNS = ["part", "filter_order", "step", "filter", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]


@pytest.mark.parametrize("seed", (1, 2))
def test_audit_equals_brute_force(spark, seed):
    rows = mixed_rows(150, seed)
    labels = [(i, random.Random(i).choice((0, 1, None)), random.Random(i + 1).choice((0, 1))) for i in range(0, 200, 2)]
    found = op12_filter_audit.audited(table_of(spark, rows).repartition(3), spark.createDataFrame(labels, LABELS)).select(COLUMNS).collect()
    assert sorted(map(tuple, found)) == sorted(brute_audit(rows, labels))


def test_audit_of_odd_tables(spark):
    labels = [(1, 1, 0), (1, None, 1), (None, 1, 1), (7, 0, 1)]
    frame = spark.createDataFrame(labels, LABELS)
    got = op12_filter_audit.audited(odd(spark), frame).select(COLUMNS).collect()
    assert sorted(map(tuple, got)) == sorted(brute_audit(ODD, [x for x in labels if x[0] is not None]))
    assert sorted(map(tuple, op12_filter_audit.audited(clashing(odd(spark)), frame).select(COLUMNS).collect())) == sorted(map(tuple, got))
    assert op12_filter_audit.audited(empty(spark), frame).count() == 0
    assert op12_filter_audit.audited(odd(spark), frame.limit(0)).where("good_lost > 0 OR toxic_lost > 0").count() == 0


def test_audit_copies_are_those_of_whole_texts(spark, monkeypatch):
    """Long texts that differ in one place, a large group of copies, and hashes that agree by chance."""
    monkeypatch.setattr(op12_filter_audit, "PART", 10)
    long = "".join(f"word{i} " for i in range(5000))
    texts = [long, long[:-2] + "X ", "Y" + long[1:], long, long[:20000] + "Z" + long[20001:], "same"] + ["hot text of many"] * 80 + ["same", "", "", None]
    docs = table_of(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)])
    rows = op12_filter_audit.measured(docs, "doc_id", "text", "lang", 16)
    classes = op12_filter_audit.refined(rows)
    want = {i for i, t in enumerate(texts) if (t or "") in [u or "" for u in texts[:i]]}
    assert {r.id for r in op12_filter_audit.repeats(docs, classes, "doc_id", "text").collect()} == want
    one = rows.select("id", "text_key", F.lit(5).cast("long").alias("class"), F.lit(len(texts)).cast("long").alias("n"))
    assert {r.id for r in op12_filter_audit.repeats(docs, one, "doc_id", "text").collect()} == want


def brute_exact(rows):
    groups = {}
    for k, r in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or ""), []).append((r[0] is None, r[0] or 0, k))
    out = []
    for text, members in groups.items():
        first = min(members)
        for none, i, k in members:
            out.append((rows[k][0], rows[first[2]][0], len(members), (none, i, k) == first, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=repr)


def exact(df, **more):
    return sorted(map(tuple, op13_exact_dedup.exact_duplicates(df, **more).collect()), key=repr)


@pytest.mark.parametrize("size", (3, 1024))
def test_exact_dedup_equals_brute_force(spark, size):
    rows = mixed_rows(120, 4)
    assert exact(table_of(spark, rows).repartition(3), size=size) == brute_exact(rows)


def test_exact_dedup_of_odd_tables(spark):
    assert exact(odd(spark)) == brute_exact(ODD) and exact(clashing(odd(spark)), size=7) == brute_exact(ODD)
    assert exact(empty(spark)) == []
    for df in (odd(spark), clashing(odd(spark))):
        out = op13_exact_dedup.deduplicated(df)
        assert out.columns == df.columns and sorted(map(str, (r.doc_id for r in out.collect()))) == ["1", "1", "2", "4", "5", "6", "7", "None"]


def test_exact_dedup_of_hot_groups_and_long_texts(spark, monkeypatch):
    """A third of the rows are copies, many share their first or last blocks, texts end at and around whole numbers of blocks."""
    monkeypatch.setattr(op13_exact_dedup, "LEAST", 8)
    common = "shared passage " * 40
    rows = [(i, "the same text in all of them " * 30, "en", "s", 1) for i in range(150)]
    rows += [(150 + i, common + f"tail {i % 90}", "en", "s", 1) for i in range(100)]
    rows += [(300 + i, f"head {i % 45:05}" + common, "en", "s", 1) for i in range(50)]
    rows += [(400 + i, "abcdefgh" * (i // 2) + "é" * (i // 7 % 2), "en", "s", 1) for i in range(80)]
    rows += [(500, "long " * 60_000, "en", "s", 1), (501, "long\n" * 60_000, "en", "s", 1), (502, "long " * 59_999 + "lang ", "en", "s", 1)]
    assert exact(table_of(spark, rows), size=64) == brute_exact(rows)
    kept = {r.doc_id for r in op13_exact_dedup.deduplicated(table_of(spark, rows)).collect()}
    assert kept == {i for i, _, _, k, _ in brute_exact(rows) if k}


def test_exact_dedup_does_not_trust_hashes(spark):
    """Blocks with one hash and different texts get different names."""
    rows = spark.createDataFrame([(i, i, 0, 77, t) for i, t in enumerate(["a", "b", "a", "c", "b", "d"])], "ref long, row long, at int, hash long, block string")
    got = {r.row: (r.level, r.name) for r in op13_exact_dedup.identities(rows).collect()}
    assert got == {0: (0, 0), 2: (0, 0), 1: (0, 1), 4: (0, 1)}
