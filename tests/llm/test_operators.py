"""The other operators against brute force, exact round trips and held-out accuracy; odd tables for all."""

import hashlib
import io
import random
import wave
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from heron.llm import op01_mixing, op02_html, op03_sharding, op04_order_minhash, op05_media, op06_language_id, op07_packing, op10_token_counts, op11_merkle, op12_filter_audit, op13_exact_dedup, registry
from heron.llm.common import running_totals
from heron.llm.tokens import Encoder, public_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Nulls anywhere, empty and long texts, repeated rows and ids, ties.
ODD = [
    (1, "the quick brown fox\njumps over the lazy dog and runs", "en", "src0", 49), (1, "the quick brown fox\njumps over the lazy dog and runs", "en", "src0", 49),
    (2, None, "en", "src0", None), (None, "no id here, but a text of some words", None, None, None), (3, "", None, "src1", 0), (4, "   \n\n ", "xx", "src1", 5), (5, "é😀ñ" * 3000 + "\n" + "word " * 4000, "fr", "src2", 1),
    (None, None, None, None, None), (6, "x", "de", "", 1), (7, "x", "de", None, 1), (7, "other text with the same id", "en", "src9", 1),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


CLASHING = """id row before part at bucket component node line band key __key __id __hash __gone __new copy n_copies shuffle_key tail size text_hash row_hash host shard
doc gone new sums parts group own unit class sketch a.b count""".split()


def clashing(df):
    """Extra columns with the names that operators use inside."""
    return df.select("*", *[F.lit(f"extra {name}").alias(name) for name in CLASHING])


OPERATORS = {
    "mixing": lambda d: op01_mixing.mixed(d),
    "html": lambda d: op02_html.extracted(d, "doc_id", "text"),
    "sharding": lambda d: op03_sharding.sharded(d),
    "fingerprints": lambda d: op04_order_minhash.fingerprints(d),
    "compared": lambda d: op04_order_minhash.compared(d),
    "media": lambda d: op05_media.media_features(op05_media.with_media(d)),
    "language": lambda d: op06_language_id.documents_identified(d),
    "packing": lambda d: op07_packing.packed(d),
    "lines": lambda d: __import__("heron.llm.op08_line_dedup", fromlist=["x"]).line_duplicates(d),
    "near": lambda d: __import__("heron.llm.op09_near_dedup", fromlist=["x"]).near_duplicates(d),
    "tokens": lambda d: op10_token_counts.token_counts(d),
    "manifest": lambda d: op11_merkle.audited(d),
    "masks": lambda d: op12_filter_audit.masks(d, d.sparkSession.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")),
    "exact": lambda d: op13_exact_dedup.exact_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_tables(spark, name):
    apply = OPERATORS[name]
    assert apply(empty(spark)).count() == 0
    plain = apply(odd(spark)).collect()
    if name in ("html", "sharding", "fingerprints", "compared", "media", "language", "near", "manifest", "masks", "exact"):
        assert len(plain) == len(ODD)
    extra = apply(clashing(odd(spark)))
    if name == "mixing":
        assert [c for c in extra.columns if c in CLASHING] == [*[c for c in CLASHING if c not in op01_mixing.ADDED], *op01_mixing.ADDED]
        extra = extra.select(*plain[0].asDict())
    assert sorted(map(repr, map(tuple, extra.collect()))) == sorted(map(repr, map(tuple, plain)))


@pytest.mark.parametrize("k", range(5))
def test_stages_on_odd_tables(spark, tmp_path, k):
    name, stage = corpus_pipeline.STAGES[k]
    found = []
    for df in (odd(spark), empty(spark), clashing(odd(spark))):
        out = stage(spark, df, "")
        assert k == 4 or out.columns == df.columns
        out.write.mode("overwrite").parquet(str(tmp_path / "out"))
        found.append(spark.read.parquet(str(tmp_path / "out")).collect())
    plain, none, extra = found
    assert not none and (plain or k < 2)
    assert sorted(map(repr, map(tuple, plain))) == sorted(repr(tuple(r)[: len(plain[0])]) for r in extra)
    assert k == 4 or all(tuple(r)[5:] == tuple(f"extra {name}" for name in CLASHING) for r in extra)


def test_mixing_reaches_weights(spark):
    rows = [(i, f"t{i}" * 50, "en", "a" if i % 3 else "b", 1) for i in range(3000)]
    out = op01_mixing.mixed(spark.createDataFrame(rows, SCHEMA), {"a": 0.25, "b": 0.5, "gone": 9.0}, 0.1)
    sizes = {r.source: r.n for r in out.groupBy("source").agg(F.sum(F.length("text")).alias("n")).collect()}
    assert abs(sizes["a"] / (sizes["a"] + sizes["b"]) - 1 / 3) < 0.03
    copies = out.groupBy("doc_id").agg(F.count("*").alias("n"), F.max("n_copies").alias("m"), F.countDistinct("copy").alias("k")).collect()
    assert all(r.n == r.m == r.k for r in copies)
    assert {(r.doc_id, r.copy) for r in out.collect()} == {(r.doc_id, r.copy) for r in op01_mixing.mixed(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7), {"a": 0.25, "b": 0.5}, 0.1).collect()}


def test_mixing_draws_are_poisson(spark):
    rows = [(i, "x", "en", "a", 1) for i in range(4000)]
    for total in (2000.0, 160_000.0):
        n = [r.n_copies for r in op01_mixing.mixed(spark.createDataFrame(rows, SCHEMA), {"a": 1.0}, 0.1, total=total).groupBy("doc_id").agg(F.max("n_copies").alias("n_copies")).collect()]
        n = np.array(n + [0] * (4000 - len(n)))
        assert abs(n.mean() / (total / 4000) - 1) < 0.06 and abs(n.var() / (total / 4000) - 1) < 0.1


@pytest.mark.parametrize("name", registry.oracle_sql())
def test_operator_equals_sql(spark, data, name):
    import duckdb

    from tests.test_catalog import rows_of

    con = duckdb.connect()
    for name_of in ("documents", "labels"):
        con.execute(f"CREATE VIEW {name_of} AS SELECT * FROM '{data}/{name_of}.parquet'")
    cur = con.execute(registry.oracle_sql()[name])
    df = registry.queries()[name](spark, data)
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns) and rows_of(df.columns, df.collect()) == rows_of(columns, cur.fetchall())


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{x:1}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href=/>Home</a></li></ul></nav><header>Top of   site</header><div class="ad">Buy now, it is very cheap today and only today</div>
<article><h1>Title &amp; more</h1><p><b>First&nbsp;block <br> goes
 on<br><p>Short.</p><aside>Side remark</aside><p>A long paragraph with &lt;brackets&gt; and enough words to be content.</p>
<div class="comments"><p>I like this very much, said a reader of this page.</p></div><form>Mail <input></form></article>
<div id="cookie-notice">We use cookies on this site</div><footer>&copy; all of us</footer>"""


def test_html_main_text():
    assert op02_html.main_text(PAGE) == "Title & more\nFirst block goes on\nShort.\nA long paragraph with <brackets> and enough words to be content."
    assert op02_html.main_text(None) == op02_html.main_text("<nav>a menu</nav>") == ""
    body = "".join(f"<p>Paragraph {i} " + "with a good number of words " * 4 + "</p>" for i in range(4))
    assert op02_html.main_text(f"<body><ul><li><a>x</a><li><a>y</a></ul><div><h2>Head</h2>{body}</div><div class='sidebar'>other</div></body>").count("\n") == 4


@pytest.mark.parametrize("n", (1, 3, 10, 30))
@pytest.mark.parametrize("closing", ("", "A closing line of about forty characters", "End."))
@pytest.mark.parametrize("foot", ("<footer>" + "<p>Foot line</p>" * 4 + "</footer>", "<div class='sidebar'><p>Other</p></div>"))
def test_html_without_article_keeps_the_end(n, closing, foot):
    want = ["Heading", *(f"Paragraph {i} {'words ' * 48}".strip() for i in range(n)), *[closing] * bool(closing)]
    body = f"<h1>{want[0]}</h1>" + "".join(f"<p>{x}</p>" for x in want[1:])
    page = f"<body><nav>{'<p><a>Menu</a></p>' * 4}</nav><div>{body}</div>{foot}</body>"
    assert op02_html.main_text(page).split("\n") == want


def brute_regions(lines):
    """The regions from their definition, in plain loops over (text, tags, linked, apart, article)."""
    from math import exp

    free = [i for i, x in enumerate(lines) if not x.apart]
    if not free:
        return []
    ratio = [len(lines[i].text) / max(1, lines[i].tags + 8 * lines[i].linked) for i in free]
    smooth = []
    for i in range(len(free)):
        near = [(exp(-0.5 * ((j - i) / 1.5) ** 2), ratio[j]) for j in range(max(0, i - 3), min(len(free), i + 4))]
        smooth.append(sum(w * r for w, r in near) / sum(w for w, _ in near))
    mean = sum(smooth) / len(smooth)
    spread = (sum((x - mean) ** 2 for x in smooth) / len(smooth)) ** 0.5
    limit = min(max(smooth), max(mean - spread / 2, 1e-9))
    core = {i for i, x in zip(free, smooth) if x >= limit - 1e-12}
    numbers = sorted({lines[i].article for i in core} - {0}) or [0]
    out = []
    for number in numbers:
        at = [i for i, x in enumerate(lines) if x.article == number and (number == 0 or not x.apart)]
        if number:  # an article is whole; no line of this test is a link onwards
            out += at
            continue
        ends = [k for k, i in enumerate(at) if i in core]
        first, last = ends[0], ends[-1]
        while first < last and lines[at[first]].linked and not lines[at[first]].heading:
            first += 1
        while last > first and lines[at[last]].linked and not lines[at[last]].heading:
            last -= 1
        plain = lambda x: not x.apart and (x.heading or not x.linked and x.tags - x.inline <= 4)
        while first > 0 and plain(lines[at[first - 1]]):
            first -= 1
        while last + 1 < len(at) and plain(lines[at[last + 1]]):
            last += 1
        out += [i for i in at[first : last + 1] if not lines[i].apart]
    return sorted(out)


def test_html_regions_equal_brute_force():
    rng = random.Random(5)
    for _ in range(600):
        articles = rng.choice(([0], [0, 1], [0, 1, 2], [1]))
        lines = [op02_html.Line("x" * rng.choice((3, 20, 80, 400)), rng.randint(0, 9), rng.random() < 0.2, rng.random() < 0.25, rng.choice(articles), rng.random() < 0.15, rng.randint(0, 3)) for _ in range(rng.randint(0, 25))]
        assert op02_html.regions(lines) == brute_regions(lines)


PARAGRAPHS = "".join(f"<p>Paragraph {i} with a good number of words in it, and then some more.</p>" for i in range(4))


@pytest.mark.parametrize("page, start, end", [
    (f'<article><p>One <span class="ad">Buy now</span>two, a long paragraph of the text here.</p>{PARAGRAPHS}<p><a href=x>Next</a></p></article>', "One two, a", "some more."),
    (f"<body><div>{PARAGRAPHS}<p><a href=x>Next</a></p></div><footer>f</footer></body>", "Paragraph 0", "some more."),
    (f"<article><header><h1>Title</h1><p>By someone</p></header>{PARAGRAPHS}<div class='share'>x</div></article>", "Title\nParagraph 0", "some more."),
    (f"<article><h1 class='entry-header'>Title</h1>{PARAGRAPHS}<p>End.</p></article>", "Title\nParagraph 0", "End."),
    (f"<header><h1>Site</h1></header><main><h2>Head</h2>{PARAGRAPHS}<ul><li>a</li><li>b</li></ul></main>", "Head\nParagraph 0", "a\nb"),
    ("<article><p>foo <b class='notice'>nota</b> bar</article>", "foo bar", "foo bar"),
])
def test_html_inline_parts_and_ends(page, start, end):
    text = op02_html.main_text(page)
    assert text.startswith(start) and text.endswith(end) and "Buy" not in text and "someone" not in text


BODY = [f"Paragraph {i} with a good number of words in it, and then some more." for i in range(4)]


@pytest.mark.parametrize("page, first, last", [
    (f"<body><nav><ul><li><a href=/>Home</a><li><a href=/a>News</a></ul><article><h1>Title</h1>{PARAGRAPHS}</article><footer>f</footer>", ["Title"], []),  # a menu that is never closed
    (f"<body><header><div>Site<article><h1>Title</h1>{PARAGRAPHS}</article></body>", ["Title"], []),
    (f"<body><aside><article><p>A teaser of some words for another page of this site.</p></article></aside><article>{PARAGRAPHS}</article>", [], []),
    (f"<body><article>{PARAGRAPHS}</article><aside><article><p>A teaser of some words for another page of this site.</p></article></aside>", [], []),
    (f"<article><h1><a href=/t>Linked title</a></h1>{PARAGRAPHS}<p><a href=/s>The source of this article</a></p></article>", ["Linked title"], ["The source of this article"]),
    (f"<div><h1><a href=/t>Linked title</a></h1>{PARAGRAPHS}</div><footer>f</footer>", ["Linked title"], []),
    (f"<article>{PARAGRAPHS}<ul><li><a href=1>First source</a></li><li><a href=2>Second source</a></li></ul></article>", [], ["First source", "Second source"]),
    (f"<body><div>{PARAGRAPHS}<p><b>The</b> <i>last</i> <em>words</em> <b>are</b> <code>set</code> <u>so</u>.</p></div><footer>f</footer></body>", [], ["The last words are set so."]),
    (f"<article>{PARAGRAPHS}</article><article class='comment'><p>I like this very much, said a reader of this page, and more.</p></article>", [], []),
    (f"<article>{PARAGRAPHS}<article class='comment'><p>I like this very much, said a reader of this page, and more.</p></article></article>", [], []),
    (f"<article class='post comments-open'>{PARAGRAPHS}</article>", [], []),
    (f"<article>{PARAGRAPHS}<p style='color:red; Display : none'>Nobody sees this long text of many words here.</p><ins class='adsbygoogle'>Buy this, it is cheap, and only today</ins></article>", [], []),
    (f"<article>{PARAGRAPHS}<p><a href=n>Next page »</a></p></article>", [], []),
])
def test_html_malformed_and_linked_pages(page, first, last):
    assert op02_html.main_text(page).split("\n") == first + BODY + last


def test_html_pages(spark, data):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{data}/pages.parquet").collect()}
    import html as h
    import re

    for r in op02_html.query(spark, data).collect():
        body = re.search(r"<article>(.*)</article>", pages[r.page_id], re.S)[1]
        want = [" ".join(h.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert r.text == "\n".join(x for x in want if x) and r.n_chars == len(r.text)


def test_sharding(spark, data):
    docs = sorted(spark.read.parquet(f"{data}/documents.parquet").collect(), key=lambda r: r.doc_id)
    got = {r.doc_id: r for r in op03_sharding.query(spark, data).collect()}
    total, before, slots = sum(len(r.text.encode()) + 1 for r in docs), 0, {}
    for r in docs:
        size = len(r.text.encode()) + 1
        shard = (2 * before + size) * 16 // (2 * total)
        x = got[r.doc_id]
        assert (x.size, x.text_crc32, x.shard, x.slot) == (size, zlib.crc32(r.text.encode()), shard, slots.get(shard, 0))
        slots[shard] = slots.get(shard, 0) + 1
        before += size


def test_running_totals(spark):
    rows = [(random.Random(i).randrange(10**6), i, i % 5) for i in range(500)]
    got = sorted(running_totals(spark.createDataFrame(rows, "k long, i long, v int"), ["k", "i"], "v").collect(), key=lambda r: r.row)
    before = 0
    for n, (r, want) in enumerate(zip(got, sorted(rows))):
        assert (r.k, r.i, r.row, r.before) == (*want[:2], n, before)
        before += want[2]


def brute_order_minhash(text, k, tuple_size, size):
    """From the definition, in sets of (hash, number) elements."""
    if not text:
        return [0] * size
    h = [int(x) for x in op04_order_minhash.kmers(text, k)]
    seen, elements = {}, []
    for place, x in enumerate(h):
        n = seen[x] = seen.get(x, -1) + 1
        e = x if not n else int(op04_order_minhash.mix(np.array([(x + n * 0xA0761D6478BD642F) % 2**64], np.uint64))[0])
        elements.append((e >> 32, place))
    out = []
    for j, order in enumerate(op04_order_minhash.constants(size, 43).tolist()):
        least = sorted(elements, key=lambda e: (e[0] * (order >> 32 | 1) % 2**32, e[1]))[:tuple_size]
        places = sorted(p for _, p in least)
        c, s = op04_order_minhash.constants(len(places), 37), op04_order_minhash.constants(size, 41)
        t = (sum(h[p] * int(w) for p, w in zip(places, c)) + int(s[j])) % 2**64
        out.append(int(op04_order_minhash.mix(np.array([t], np.uint64))[0]) >> 48)
    return out


def test_order_minhash_definition():
    for text in ("a", "abcdefgh", "abcabcabcabcabcabcabc" * 4, "the quick brown fox jumps over the lazy dog " * 3, "é😀" * 30, "".join(random.Random(3).choice("abcd ef") for _ in range(5000))):
        assert op04_order_minhash.order_minhash(text).tolist() == brute_order_minhash(text, 8, 2, 64)


def test_order_minhash_orders_are_independent():
    """The likeness of texts that share a part of their k-mers varies as a mean of independent draws does."""
    rng, found = random.Random(8), []
    for _ in range(150):
        words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(30)) for _ in range(12)]
        a, b = (op04_order_minhash.order_minhash(" ".join(x)) for x in (words, words[:8] + words[4:0:-1]))
        found.append(op04_order_minhash.likeness(a, b))
    p = np.mean(found)
    assert 0.05 < p < 0.95 and np.var(found) < 1.6 * p * (1 - p) / op04_order_minhash.SIZE


def test_order_minhash_tells_edits_from_shuffles():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(400)]
    a = op04_order_minhash.order_minhash(" ".join(words))
    few = list(words)
    few[100:103] = ["changed"]
    moved = [" ".join(words[i : i + 10]) for i in range(0, 400, 10)]
    rng.shuffle(moved)
    near, far = (op04_order_minhash.likeness(a, op04_order_minhash.order_minhash(t)) for t in (" ".join(few), " ".join(moved)))
    assert near > 0.85 > far + 0.2


def test_compared(spark, data):
    docs = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{data}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in op04_order_minhash.query(spark, data).collect()}
    assert len(got) == len(docs)
    for (i, t), (_, u) in zip(docs, docs[1:] + docs[:1]):
        e = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(e.encode()).hexdigest())
        a, b, c = map(op04_order_minhash.order_minhash, (t, e, u))
        assert (r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next) == (a.astype(">u2").tobytes().hex(), b.astype(">u2").tobytes().hex(), (a == b).mean(), (a == c).mean())


def test_compared_rows_without_id(spark):
    """Rows without id stand below all others, in the descending order of their texts' hashes."""
    rows = [(i if i % 3 else None, f"text {i} of the table " * (i % 5 + 1)) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [r.text for r in df.orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).collect()]
    want = sorted(hashlib.sha256(op04_order_minhash.edited(t, u).encode()).hexdigest() for t, u in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 for r in op04_order_minhash.compared(df).collect()) == want


def test_compared_rows_of_a_frequent_id(spark, monkeypatch):
    """Rows of one id that is a third of all are dealt to many ranges, in the descending order of their texts' hashes; no neighbour is lost."""
    monkeypatch.setattr(op04_order_minhash, "FREQUENT", 20)
    rows = [(7 if i % 3 else i, f"text {i} of the table " * (i % 5 + 1)) for i in range(240)] + [(None, f"none {i}") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    ranges = op04_order_minhash.followed(df).where("NOT tail AND id = 7").groupBy("bucket").count().collect()
    assert len(ranges) > 20 and max(r["count"] for r in ranges) < 20
    order = [r.text for r in df.orderBy(F.desc_nulls_last("doc_id"), F.desc(F.xxhash64("text"))).collect()]
    want = sorted(hashlib.sha256(op04_order_minhash.edited(t, u).encode()).hexdigest() for t, u in zip(order, order[1:] + order[:1]))
    assert sorted(r.edited_sha256 for r in op04_order_minhash.compared(df).collect()) == want


def test_media(spark, data):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    stored = {r.id: bytes(r.media) for r in op05_media.with_media(spark.read.parquet(f"{data}/documents.parquet")).collect()}
    for r in op05_media.query(spark, data).collect():
        raw = texts[r.doc_id].encode()
        payload = raw + bytes(-len(raw) % 64)
        with wave.open(io.BytesIO(stored[r.doc_id])) as w:
            assert w.readframes(w.getnframes()) == payload
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(stored[r.doc_id]), hashlib.sha256(stored[r.doc_id]).hexdigest())


def brute_landmarks(payload):
    """Peaks and pairs in plain loops: frames of 256 samples every 128 between 128 samples of silence, three strongest peaks, three next peaks within 16 frames."""
    x = [0.0] * 128 + [float(v) - 128 for v in payload]
    x += [0.0] * (128 + -len(payload) % 128)
    peaks = []
    for t in range((len(x) - 256) // 128 + 1):
        frame = np.array(x[t * 128 : t * 128 + 256], np.float32) * np.hanning(256).astype(np.float32)
        power = np.abs(np.fft.rfft(frame)) ** 2
        mean = power[1:-1].mean()
        top = sorted(((power[b], b) for b in range(1, 128) if power[b] > power[b - 1] and power[b] >= power[b + 1] and power[b] > 1 + mean), reverse=True)[:3]
        peaks += sorted((t, b) for _, b in top)
    return sorted((t, b << 16 | c << 8 | u - t) for i, (t, b) in enumerate(peaks) for u, c in peaks[i + 1 : i + 4] if u - t <= 16)


def test_media_landmarks_equal_brute_force(spark):
    texts = ["", "short", "a" * 300, "the quick brown fox jumps over the lazy dog, " * 60, "".join(random.Random(2).choice("abc dé😀,.") for _ in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in op05_media.media_features(op05_media.with_media(docs)).collect():
        want = brute_landmarks(op05_media.padded(texts[r.id]))
        assert list(zip(r.landmark_at, r.landmark)) == want and r.n_landmarks == len(want)
        arrays = [np.array(x, "<i4").tobytes() for x in (r.landmark_at, r.landmark)]
        assert r.feature == f"{len(want)}:{hashlib.sha256(b''.join(arrays)).hexdigest()}"


@pytest.mark.parametrize("n", (64, 256, 320, 448, 512, 1088))
def test_media_frames_cover_all_samples(n):
    rng = np.random.default_rng(n)
    loud = rng.integers(0, 256, n).astype(np.uint8)
    frames = op05_media.framed(loud) * op05_media._WINDOW
    for place in (0, n // 2, n - 65, n - 64, n - 2, n - 1):
        other = loud.copy()
        other[place] ^= 128
        assert (op05_media.framed(other) * op05_media._WINDOW != frames).any(), place
    tail = loud.copy()
    tail[-64:] = rng.integers(0, 256, 64)
    assert [x.tolist() for x in op05_media.landmarks(tail)] != [x.tolist() for x in op05_media.landmarks(loud)]


def test_landmarks_survive_gain():
    t = np.arange(16000) / 8000
    tune = 60 * np.sin(2 * np.pi * (500 + 300 * np.floor(t * 4) % 1700) * t)
    a, b = (set(zip(*map(np.ndarray.tolist, op05_media.landmarks((128 + g * tune).astype(np.uint8))))) for g in (1.0, 0.7))
    assert len(a) > 50 and len(a & b) / len(a | b) > 0.5


def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = op06_language_id.fit(docs.where("doc_id % 2 = 0"))
    held = docs.where("doc_id % 2 = 1 AND n_chars > 30")
    found = {r.id: r for r in op06_language_id.identified(held, model, host=F.col("source")).collect()}
    truth = {r.doc_id: r.lang for r in held.collect()}
    assert sum(found[i].language == truth[i] for i in truth) / len(truth) > 0.98
    assert sum(r.kept for r in found.values()) / len(found) > 0.98


def test_language_evidence_is_fused(spark):
    rows = [(f"u{i}", "das ist der hund und die katze im haus", "de", "a.de") for i in range(30)] + [(f"v{i}", "this is the dog and the cat in the house", "en", "b.com") for i in range(30)] + [("x", "ok", "de", "a.de"), ("y", "ok", "en", "b.com"), ("z", "", "de", "a.de")]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string, host string")
    model = op06_language_id.fit(df.where("length(text) > 5"))
    found = {r.id: r for r in op06_language_id.identified(df, model, declared=F.col("lang"), host=F.col("host"), suffix=op06_language_id.suffix_of(F.col("host"))).collect()}
    assert found["x"].language == "de" and found["y"].language == "en" and found["x"].kept
    assert found["z"].language is None and not found["z"].kept


def test_documents_carry_all_evidence(spark):
    words = {"de": "das ist der hund und die katze im haus", "en": "this is the dog and the cat in the house"}
    rows = [(f"{lang}{i}", text, lang, f"https://h{i}.example.{at}/page") for lang, text, at in (("de", words["de"], "de"), ("en", words["en"], "com")) for i in range(30)]
    page = '<!DOCTYPE html>\n<html lang="{}">{}'
    rows += [(f"page-{lang}{i}", page.format(lang, text), lang, "crawl") for lang, text in words.items() for i in range(30)]
    unsure = [("suffix-de", "ok", None, "http://new.example.de/x"), ("suffix-com", "ok", None, "http://new.example.com/x"), ("plain-de", page.format("de", "ok"), None, "crawl"), ("plain-en", page.format("en", "ok"), None, "crawl")]
    found = {r.id: r for r in op06_language_id.documents_identified(spark.createDataFrame(rows + unsure, "doc_id string, text string, lang string, source string")).collect()}
    assert [found[x].language for x in ("suffix-de", "suffix-com", "plain-de", "plain-en")] == ["de", "en", "de", "en"]
    assert all(found[r[0]].language == r[2] for r in rows)


def brute_language(rows, model):
    """rows (id, text, declared, host, suffix) to {id: (language, posterior, kept)}, the fusion in plain Python."""
    from collections import Counter
    from math import exp, log

    names, n, lean = model.languages, len(model.languages), op06_language_id.LEAN
    scored = [(i, *model.score(t), d if d is None or d in names else "other", h or "", s or "") for i, t, d, h, s in rows]
    best = [names[int(np.argmax(s))] if k else None for _, s, k, *_ in scored]
    overall, by_suffix, by_host, told = Counter(), {}, {}, Counter()
    for (_, _, _, d, h, s), b in zip(scored, best):
        if b:
            overall[b] += 1
            by_suffix.setdefault(s, Counter())[b] += 1
            by_host.setdefault((h, s), Counter())[b] += 1
            told[d, b] += d is not None
    total, all_told = max(1, sum(overall.values())), sum(told.values())
    base = {a: (overall[a] + 1) / (total + n) for a in names}
    leaned = lambda own, up: {a: (own[a] + lean * up[a]) / (sum(own.values()) + lean) for a in names}
    out = {}
    for (i, s, k, d, h, suffix), b in zip(scored, best):
        up = base if suffix == "" or suffix not in by_suffix else leaned(by_suffix[suffix], base)
        prior = base if (h, suffix) not in by_host else up if h == "" else leaned(by_host[h, suffix], up)
        logs = []
        for j, a in enumerate(names):
            share = (sum(told[d, x] for x in names) + 1) / (all_told + n)
            evidence = 0 if d is None else log((told[d, a] + lean * share) / (sum(told[x, a] for x in names) + lean))
            logs.append(float(s[j] - s.max()) + evidence + log(prior[a]))
        if not k:
            out[i] = (None, None, False)
            continue
        top = max(logs)
        p, language = 1 / sum(exp(x - top) for x in logs), names[logs.index(top)]
        out[i] = (language, p, p >= op06_language_id.CERTAIN and language != "other")
    return out


def test_language_equals_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    model, rng = op06_language_id.fit(docs), random.Random(4)
    rows = [(r.doc_id, r.text[: rng.choice((5, 20, 2000))], rng.choice((r.lang, r.lang, None, "xx", "en")), rng.choice(("a.de", "b.de", "c.com", None)), None) for r in docs.collect()]
    rows = [(i, t, d, h, h.split(".")[1] if h else None) for i, t, d, h, _ in rows] + [(-1, "", "de", "a.de", "de"), (-2, None, None, None, None), (-3, "12 34", "de", "a.de", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, declared string, host string, suffix string")
    want = brute_language(rows, model)
    for r in op06_language_id.identified(df, model, declared=F.col("declared"), host=F.col("host"), suffix=F.col("suffix")).collect():
        language, posterior, kept = want[r.id]
        assert (r.language, r.kept) == (language, kept) and (posterior is None) == (r.posterior is None) and abs((posterior or 0) - (r.posterior or 0)) < 1e-4


def test_trigram_runs_meet():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice("aé .9ñ") for _ in range(rng.randint(0, 40)))
        want = op06_language_id.trigrams(text).tolist()
        for run in (1, 2, 3, 7):
            assert [x for r in op06_language_id.trigram_runs(text, run) for x in r.tolist()] == want


def test_language_rare_many_and_unknown(spark):
    rng = random.Random(6)

    def speaker(k):
        """Texts of words of a vocabulary of its own."""
        own = random.Random(k)
        words = ["".join(own.choice("abcdefghijklmnopqrstuvwxyzåäöéñ") for _ in range(own.randrange(3, 8))) for _ in range(60)]
        return lambda: " ".join(rng.choice(words) for _ in range(40))

    speakers = {f"l{k}": speaker(k) for k in range(20)}
    rows = [(f"{x}-{i}", speakers[x](), x) for k, x in enumerate(speakers) for i in range(400 if k < 2 else 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, lang string")
    model = op06_language_id.fit(df, most=100)
    assert model.languages == [*sorted(speakers), "other"]
    unknown = [(f"n{i}", speaker(100 + i % 3)(), "l0") for i in range(60)]
    unknown += [(f"r{i}", "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(200)), "l1") for i in range(60)]
    unknown += [(f"c{i}", "все люди рождаются свободными и равными в своем достоинстве и правах", "l0") for i in range(5)]
    found = {r.id: r for r in op06_language_id.identified(df.union(spark.createDataFrame(unknown, df.schema)), model, declared=F.col("lang")).collect()}
    assert all(found[i].language == x and found[i].kept for i, _, x in rows)
    assert all(found[i].language == "other" and not found[i].kept for i, _, _ in unknown)


def test_language_bound_is_an_error(spark):
    df = spark.createDataFrame([(i, "some text", f"label{i}") for i in range(op06_language_id.MOST_LANGUAGES + 1)], "doc_id long, text string, lang string")
    with pytest.raises(ValueError, match="labels"):
        op06_language_id.fit(df)
    assert len(op06_language_id.fit(df.where("doc_id > 0")).languages) == op06_language_id.MOST_LANGUAGES + 1


def test_pages_language(spark, data):
    rows = registry.queries()["pages_language"](spark, data).collect()
    assert len(rows) == 50 and sum(r.kept for r in rows) >= 48


def test_encoder_reads_long_white_space():
    own = Encoder(public_path())
    for text in (" " * 2_000_000, "a" + "\n" * 1_200_000 + "b"):
        assert np.frombuffer(own.encode([text])[0], own.dtype).tolist() == own.plain(text)


TRICKY = ["", " ", "a", " a", "a ", "a  b", "a \n b", "it's we'll\n\nx", "tab\there", "  lead", "é 😀 ñ", "12 345", "a b  c", "x" * 3000, "!! ?? .", "a\x1cb \x85c", "end\n", "<|endoftext|> a <|endoftext|>", "don 't 's"]


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer

    plain, own = Tokenizer.from_file(public_path()), Encoder(public_path())
    rng = random.Random(2)
    texts = TRICKY + ["".join(rng.choice("ab  \n.'1é😀s") for _ in range(60)) for _ in range(300)]
    for chunk in (texts[:50], texts[50:]):
        for t, ids in zip(chunk, own.encode(chunk)):
            assert np.frombuffer(ids, own.dtype).tolist() == plain.encode(t, add_special_tokens=False).ids, repr(t)


def test_packing(spark, data):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path())
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    pieces = op07_packing.query(spark, data).collect()
    ids = {i: [*plain.encode(t, add_special_tokens=False).ids, 1] for i, t in texts.items()}
    by_doc, by_sequence = {}, {}
    for p in pieces:
        piece = np.array(ids[p.doc_id][p.start : p.start + p.length], "<u4")
        assert p.ids_crc32 == zlib.crc32(piece.tobytes()) and p.doc_tokens == len(ids[p.doc_id]) and p.length > 0
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length)), by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    for i, x in ids.items():
        at = 0
        for start, n in sorted(by_doc[i]):
            assert start == at
            at += n
        assert at == len(x)
    along = [p.curve for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert along == sorted(along)  # neighbours in a sequence are neighbours on the curve
    for s, x in by_sequence.items():
        at = 0
        for start, n in sorted(x):
            assert start == at
            at += n
        assert at == 2048 or s == max(by_sequence)


def test_hilbert_is_a_curve():
    n, bits = 3, 3
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * n, indexing="ij"), -1).reshape(-1, n).astype(np.uint64)
    keys = op07_packing.hilbert(cells, bits)
    assert sorted(keys.tolist()) == list(range(1 << bits * n))
    walk = cells[np.argsort(keys)].astype(int)
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


@pytest.mark.parametrize("rule", op10_token_counts.RULES)
def test_token_counts(spark, rule):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(public_path())
    texts = [t for t in TRICKY if "<|" not in t] + ["a \n\n\n b\n", "é\nñ\n\n😀 x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {(r.id, r.section): r for r in op10_token_counts.token_counts(df, rule=rule).collect()}
    for i, t in enumerate(texts):
        data, spans, at = t.encode(), [], 0
        for token in plain.encode(t, add_special_tokens=False).ids:
            n = len(plain.id_to_token(token))
            spans.append((at, at + n))
            at += n
        assert at == len(data)
        cuts = [0] + [k + 1 for k, c in enumerate(data) if c == 10]
        section = lambda b: sum(c <= b for c in cuts) - 1
        want = [0] * len(cuts)
        for a, b in spans:
            inside = [section(x) for x in range(a, b)]
            want[{"start": inside[0], "end": inside[-1], "majority": max(sorted(set(inside)), key=inside.count)}[rule]] += 1
        assert [got[i, s].n_tokens for s in range(len(cuts))] == want and (i, len(cuts)) not in got
        lines = t.split("\n")
        assert [got[i, s].char_end - got[i, s].char_start for s in range(len(cuts))] == [len(x) + 1 for x in lines[:-1]] + [len(lines[-1])]


def test_token_counts_of_fields(spark):
    df = spark.createDataFrame([(1, "title here", "body one\nbody two", None)], "doc_id long, a string, b string, c string")
    rows = op10_token_counts.token_counts(df, fields=("a", "b", "c"), lines=False).collect()
    assert [(r.field, r.char_start, r.char_end) for r in rows] == [("a", 0, 11), ("b", 11, 29), ("c", 29, 29)] and rows[2].n_tokens == 0


def test_pipeline(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    pieces = corpus_pipeline.run(spark, data)
    out = pieces.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()
    assert sum(r.n != 2048 for r in out) <= 1
    assert pieces.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0


def test_language_evidence_grows_smoothly():
    """A longer text of the same kind is a better witness at every length, in ever smaller steps and without a bound."""
    model = op06_language_id.TextModel(["a", "b"], np.array([[0.0] * op06_language_id.BUCKETS, [-1.0] * op06_language_id.BUCKETS], np.float32))
    gaps = []
    for n in (1, 2, 10, 100, 300, 399, 400, 401, 1000, 10_000, 100_000):
        (a, b), k = model.score("x" * n)
        gaps.append((k, float(a - b)))
    assert all(y > x for (_, x), (_, y) in zip(gaps, gaps[1:]))
    rates = [y / k for k, y in gaps]
    assert all(x > y for x, y in zip(rates, rates[1:])) and abs(rates[0] - op06_language_id.TEMPER) < 0.01
