"""Every registered query against its SQL on the small tables; those without SQL against what must hold for their rows."""

import math

import duckdb
import pytest

from heron.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x + 0.0:.5f}"
    if isinstance(x, bool) or x is None:
        return str(x)
    return f"{x:.5f}" if isinstance(x, int) else str(x)


def rows_of(columns, rows):
    at = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in at) for r in rows)


def one(duck, sql):
    return duck.execute(sql).fetchone()[0]


#: What holds for the rows of queries that SQL can't express; tests/test_library.py has brute force for them.
WITHOUT_SQL = {
    "vec_ivf_recall": lambda rows, duck: sum(r.recall for r in rows) / len(rows) >= 0.9 and len(rows) == one(duck, "SELECT count(*) FROM embeddings WHERE vec_id % 20 = 0"),
    "pq_recall": lambda rows, duck: rows[0].recall >= 0.9 and rows[0].vectors_read <= 0.02 and rows[0].code_bytes <= 0.125,
    "kmeans_centroids": lambda rows, duck: sum(r.n for r in rows) == one(duck, "SELECT count(*) FROM embeddings") and 0 < rows[0].inertia < one(duck, "SELECT sum(list_inner_product(embedding, embedding)) FROM embeddings"),
    "pii_find": lambda rows, duck: sum(r.kind == "email" for r in rows) == one(duck, "SELECT sum(len(regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Z|a-z]{2,}'))) FROM documents"),
    "rouge_l": lambda rows, duck: len(rows) == one(duck, "SELECT count(*) - 1 FROM benchmark") and all(0 <= r.rouge < 1 for r in rows),
    "chunk_recursive": lambda rows, duck: len({r.id for r in rows}) == one(duck, "SELECT count(*) FROM documents WHERE trim(text, E' \\n\\t') != ''") and all(r.start < r.end for r in rows),
    "chunk_markdown": lambda rows, duck: len(rows) > 0 and all(r.start < r.end and len(r.text) >= 50 for r in rows),
    "chunk_code": lambda rows, duck: len({r.id for r in rows}) == one(duck, "SELECT count(*) FROM pages"),
    "chunk_stats": lambda rows, duck: rows[0].n_chunks > one(duck, "SELECT count(*) FROM documents WHERE text != ''") and rows[0].min_size <= rows[0].avg_size <= rows[0].max_size,
    "clauses": lambda rows, duck: " ".join(r.clause for r in sorted(rows, key=lambda r: (r.item_id, r.at)) if r.item_id == 0) == " ".join(one(duck, "SELECT text FROM benchmark WHERE item_id = 0").split()),
    "text_language": lambda rows, duck: sum(r.n for r in rows if r.lang == r.found) > 0.7 * sum(r.n for r in rows),
    "ingest": lambda rows, duck: len({r.chunk_id for r in rows}) == len(rows) > 0 and all(r.dimensions == 256 for r in rows),
    "ages_and_sizes": lambda rows, duck: len(rows) == one(duck, "SELECT count(*) FROM events") and all(r.ms >= 0 for r in rows),
    "rate_limit_admitted": lambda rows, duck: len(rows) == one(duck, "SELECT count(*) FROM events") and sum(r.allowed for r in rows) >= one(duck, "SELECT count(*) FROM (SELECT count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3600000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n <= 3"),
    "semantic_sized": lambda rows, duck: sum(r.last - r.first + 1 for r in rows) == one(duck, "SELECT count(*) FROM conversations"),
}


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, data, name):
    df = catalog.QUERIES[name](spark, data)
    got = df.collect()
    if name not in catalog.SQL:
        assert len(df.columns) == len(set(df.columns)) and WITHOUT_SQL[name](got, duck)
        return
    cur = duck.execute(catalog.SQL[name])
    columns = [x[0] for x in cur.description]
    assert sorted(columns) == sorted(df.columns)
    want = rows_of(columns, cur.fetchall())
    assert rows_of(df.columns, got) == want
