"""Vector queries beyond the sizes of the small tables."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from heron.operators import codes, duplicates, graph, search
from heron.plans import catalog, vector_queries


def test_kmeans_uses_all_vectors(spark, tmp_path, monkeypatch):
    rows = spark.range(50_010).select(F.col("id").alias("vec_id"), F.array(F.col("id") % 10 * 100.0, F.col("id") % 7 * 0.1).cast("array<float>").alias("embedding"), F.lit(0).alias("label"))
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))

    def sampled(*args, **kwargs):
        raise AssertionError("a sample was taken")

    monkeypatch.setattr(type(rows), "sample", sampled)
    assert sum(r.n for r in catalog.QUERIES["kmeans_centroids"](spark, str(tmp_path)).collect()) == 50_010


def test_search_in_bounded_memory(spark, monkeypatch):
    """Queries in several blocks, lists of any size and many ties: the k best by score and id, with few scores at once."""
    rng = np.random.default_rng(2)
    v = rng.integers(-1, 2, (400, 3)).astype(np.float64)  # 27 different vectors
    v[0] = 1, 0, 1
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(v)], "id long, vector array<float>").repartition(3)
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    held = []
    rough = search.VectorScores.rough

    def wanted(metric):
        out = []
        for i in range(0, 400, 20):
            dots, sizes = v @ v[i], np.linalg.norm(v, axis=1) * np.linalg.norm(v[i])
            s = {"dot": dots, "cosine": np.divide(dots, sizes, out=np.zeros(400), where=sizes > 0), "euclidean": 1 / (1 + np.linalg.norm(v - v[i], axis=1))}[metric]
            out += [(i, r + 1, j) for r, j in enumerate(sorted(range(400), key=lambda j: (-round(s[j], 9), j))[:30])]
        return out

    best = search.Best(pa.array([1, 2, 3]), search.VectorScores("dot", v[:3]), 5)
    monkeypatch.setattr(search.VectorScores, "rough", lambda self, *x: held.append((out := rough(self, *x))[0].size) or out)
    best.add(pa.array(range(60_000)), search.VectorScores.columns(np.tile(v, (150, 1))))
    assert max(held) <= search.SCORES and sum(b.num_rows for b in best.found()) == 15
    monkeypatch.undo()
    key = lambda df: sorted((r.query_id, r["rank"], r.id) for r in df.collect())
    for block in (4096, 1):
        monkeypatch.setattr(search, "QUERY_BLOCK", block), monkeypatch.setattr(search, "ROW_BLOCK", 50)
        for metric in ("cosine", "dot", "euclidean"):
            assert key(search.batch_top_k(rows, queries, 30, metric)) == wanted(metric), (block, metric)
    centroids = search.fit_centroids(rows, 4)
    assert key(search.probe(search.assign(rows, centroids), centroids, queries, 30, probes=4)) == wanted("cosine")


def test_codes_take_any_number_of_queries(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(4)
    rows = spark.createDataFrame([(i, [float(c) for c in rng.standard_normal(8)]) for i in range(300)], "id long, vector array<float>")
    queries = rows.where("id % 20 = 0").select(F.col("id").alias("query_id"), "vector")
    codes.write_codes(rows, str(tmp_path / "c"), m=4, k=16, lists=3)
    stored = codes.Codes(spark, str(tmp_path / "c"))
    for probes in (None, 2):
        one = sorted(map(tuple, stored.candidates(queries, 20, probes=probes).collect()))
        monkeypatch.setattr(search, "QUERY_BLOCK", 4)
        assert sorted(map(tuple, stored.candidates(queries, 20, probes=probes).collect())) == one and len(one) == 300
        assert stored.search(queries, 5, wider=4, probes=probes).count() == 75
        monkeypatch.undo()


def test_families_of_similar_vectors_leave_few_rows(spark, monkeypatch):
    """A family of near copies is one group, joined by links in proportion to its size, in buckets of one block or of many."""
    rng = np.random.default_rng(8)
    base = np.concatenate([np.tile(rng.standard_normal(16), (600, 1)), rng.standard_normal((300, 16))])
    rows = spark.createDataFrame([(i, [float(c) for c in x]) for i, x in enumerate(base + rng.normal(0, 0.01, base.shape))], "id long, vector array<float>")
    seen, plain = [], duplicates.components
    monkeypatch.setattr(duplicates, "components", lambda df: seen.append(df.count()) or plain(df))
    for bucket in (512, 64):
        monkeypatch.setattr(duplicates, "BUCKET", bucket)
        family = [r.id for r in duplicates.similar_groups(rows, 0.9).where("component = 0").collect()]
        assert sorted(family)[:600] == list(range(600))
        assert seen[-1] < 30_000  # of 179,700 pairs


def test_links_are_joined_in_tasks_first(spark):
    """What tasks make of links joins the same nodes, with one link for each node of a task at most."""
    rng = np.random.default_rng(1)
    hub = [(0, i) for i in range(1, 200)] + [(int(a), int(b)) for a, b in rng.integers(1, 200, (3000, 2)) if a != b] + [(i, i + 1) for i in range(300, 340)]
    for kind, named in (("long", lambda i: i), ("string", str)):
        edges = spark.createDataFrame([(named(a), named(b)) for a, b in hub], f"u {kind}, v {kind}")
        assert graph.joined(edges.coalesce(1)).count() == 199 + 40
        found = {r.node: r.component for r in graph.components(edges.repartition(3)).collect()}
        assert found == {named(i): named(0) for i in range(200)} | {named(i): named(300) for i in range(300, 341)}


def test_ranks_list_few_relevant_rows(spark, tmp_path, monkeypatch):
    """One label holds all rows but some: the metrics get no list of it, and are those of all relevant rows."""
    rng = np.random.default_rng(4)
    v, labels = rng.standard_normal((600, 8)).astype(np.float32), [None if i % 50 == 7 else int(i % 40 == 0) for i in range(600)]
    spark.createDataFrame([(i, [float(c) for c in x], labels[i]) for i, x in enumerate(v)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    listed, ndcg, mrr = [], vector_queries.metrics.ndcg, vector_queries.metrics.mrr
    monkeypatch.setattr(vector_queries.metrics, "ndcg", lambda ranked, gains, k: (listed.append(gains.count()), ndcg(ranked, gains, k))[1])
    monkeypatch.setattr(vector_queries.metrics, "mrr", lambda ranked, relevant: (listed.append(relevant.count()), mrr(ranked, relevant))[1])
    got = {r.query_id: r.ndcg for r in catalog.QUERIES["rank_ndcg"](spark, str(tmp_path)).collect()}
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    firsts = []
    for q in range(0, 600, 20):
        near = [i for i in np.argsort(-(unit @ unit[q]), kind="stable")[:11] if i != q]
        same = [i for i in range(600) if i != q and labels[q] is not None and labels[i] == labels[q]]
        ideal = sum(g / np.log2(k + 2) for k, g in enumerate(sorted((1.0 + i % 3 for i in same), reverse=True)[:10]))
        assert abs(got[q] - (sum((1.0 + i % 3) / np.log2(k + 2) for k, i in enumerate(near) if i in same) / ideal if ideal else 0)) < 2e-6
        firsts.append(next((1 / (k + 1) for k, i in enumerate(near) if i in same), 0))
    assert abs(catalog.QUERIES["rank_mrr"](spark, str(tmp_path)).first().mrr - np.mean(firsts)) < 2e-6
    assert len(got) == 30 and len(listed) == 2 and max(listed) <= 30 * 21
