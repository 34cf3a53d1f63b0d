"""The pipeline against a plain restatement of its five stages, run one after the other on a small table."""

import hashlib
import random
from collections import Counter
from math import ceil, exp

import numpy as np

import corpus_pipeline
from heron.llm import op01_mixing as mixing
from heron.llm import op06_language_id as language
from heron.llm import op08_line_dedup as lines
from heron.llm.tokens import public_path
from tests.llm.test_near import brute_lines, brute_near
from tests.llm.test_operators import SCHEMA, brute_language

EN = "the quick brown fox jumps over a lazy dog while some people watch it from their small wooden house near river bank and talk about weather".split()
DE = "der schnelle braune fuchs springt über einen faulen hund während einige leute aus ihrem kleinen holzhaus am fluss zuschauen und über das wetter reden".split()


def corpus():
    rng, rows = random.Random(12), []

    def line(words):
        return " ".join(rng.choice(words) for _ in range(rng.randint(6, 14)))

    for _ in range(50):
        lang, words = rng.choice((("en", EN), ("de", DE)))
        body = [line(words) for _ in range(rng.randint(2, 6))]
        rows.append(("\n".join(body), lang))
        if rng.random() < 0.4:  # a near copy: one word of a long text changed, line breaks lost
            copy = " ".join(body).split()
            copy[rng.randrange(len(copy))] = "changed"
            rows.append((" ".join(copy), lang))
        if rng.random() < 0.3:  # repeats a line, with an edit
            rows.append((body[0][:-1] + "\n" + line(words), lang))
        if rng.random() < 0.2:
            rows.append((rows[-1][0], lang))
    rows += [("", "en"), ("12 34 56", "en"), (None, "de"), ("xkqz vvwq zzkx qqqw xxkz wwvq", "en"), ("Read more\n" + line(EN), "en"), ("Read more\n" + line(EN), "en")]
    return [(i * 3, t, lang, rng.choice(("src0", "src1", "src7", None)), None if t is None else len(t)) for i, (t, lang) in enumerate(rows)]


def uniform(*parts):
    return int(hashlib.md5(":".join(parts).encode()).hexdigest()[:13], 16) / 2**52


def counts(rows):
    """Copies of each row by the Poisson distribution of its source's rate."""
    bucket = lambda r: r[3] if r[3] in mixing.WEIGHTS else "*"
    sizes = Counter()
    for r in rows:
        sizes[bucket(r)] += len((r[1] or "").encode())
    sizes = {b: n for b, n in sizes.items() if n}
    shares = {b: mixing.WEIGHTS.get(b, mixing.REST) for b in sizes}
    out = []
    for r in rows:
        if bucket(r) not in sizes:
            continue
        rate = shares[bucket(r)] / sum(shares.values()) * sum(sizes.values()) / sizes[bucket(r)]
        n = max(1, ceil(rate / mixing.PART))
        copies = 0
        for j in range(1, n + 1):
            u, p, total, k = uniform(str(mixing.SEED), str(r[0]), str(j)), exp(-rate / n), exp(-rate / n), 0
            while total <= u:
                k += 1
                p *= rate / n / k
                total += p
            copies += k
        out += [r] * copies
    return out


def brute_pipeline(rows, model):
    judged = brute_language([(r[0], r[1], None, r[3], None) for r in rows], model)
    rows = [r for r in rows if judged[r[0]][2]]
    keep, out = brute_lines([(r[0], r[1]) for r in rows], lines.EDITS, lines.CHARS), []
    for i, t, *rest in rows:
        parts = t.split("\n")
        left = [x for at, x in enumerate(parts) if keep[i, at][3]]
        if left:
            out.append((i, "\n".join(left), *rest))
    near = brute_near([(r[0], r[1]) for r in out], 5, 80)
    kept = [r for r in out if near[r[0]][2]]
    assert len(rows) > len(out) > len(kept)
    return counts(kept)


def test_run_equals_brute_force(spark, tmp_path):
    from tokenizers import Tokenizer

    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    want, plain = brute_pipeline(rows, language.fit(docs)), Tokenizer.from_file(public_path())
    pieces = sorted(corpus_pipeline.run(spark, str(tmp_path)).collect(), key=lambda p: (p.sequence_id, p.offset))
    packed, at = [], 0
    for p in pieces:  # the sequences end to end are the documents end to end
        assert p.sequence_id * 2048 + p.offset == at
        at += p.length
        ids = np.frombuffer(p.ids, "<u4").tolist()
        if p.start == 0:
            packed.append((p.doc_id, ids))
        else:
            assert packed[-1][0] == p.doc_id and len(packed[-1][1]) == p.start
            packed[-1][1].extend(ids)
    found = Counter((i, tuple(ids)) for i, ids in packed)
    assert found == Counter((r[0], (*plain.encode(r[1], add_special_tokens=False).ids, 1)) for r in want)
