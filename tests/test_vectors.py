"""The vector index against brute force: recall, exact hits, files read."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from chronoloom.operators import resolution, search, vectors


def table(spark, rows):
    return spark.createDataFrame(rows, "key string, embedding array<double>, score string, cell int")


def clustered(n=600, dim=8, seed=4):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dim))
    x = centres[r.integers(0, 12, n)] + 0.25 * r.normal(size=(n, dim))
    return [(f"k{i:04d}", [float(v) for v in row], "s", 1) for i, row in enumerate(x)]


def brute(rows, queries, k):
    out = set()
    for q, v in queries:
        hits = []
        for key, w, *_ in rows:
            a, b = np.array(v), np.array(w)
            s = round(float(a @ b / (np.sqrt(a @ a) * np.sqrt(b @ b) + 1e-9)), 6) + 0.0
            hits.append((-s, key))
        out |= {(q, key, -s + 0.0, i + 1) for i, (s, key) in enumerate(sorted(hits)[:k])}
    return out


def asked(spark, queries):
    return spark.createDataFrame(queries, "q string, embedding array<double>")


def test_exact_search_equals_brute_force_with_ties_zeros_and_copies(spark):
    rows = clustered(300) + [(f"z{i}", [0.0] * 8, "s", 1) for i in range(3)] + [(f"c{i}", [1.0] * 8, "s", 1) for i in range(200)]
    odd = [("n1", None, "s", 1), ("n2", [1.0, 2.0], "s", 1), ("n3", [None] * 8, "s", 1)]
    index = vectors.build(table(spark, rows + odd), "key", cells=9, block_bytes=8 * 8 * 16)
    queries = [(f"q{i}", rows[i * 7][1]) for i in range(20)] + [("zero", [0.0] * 8), ("ones", [1.0] * 8), ("far", [-1.0] * 8)]
    got = {(r.q, r.key, r.score + 0.0, r["rank"]) for r in vectors.search(index, asked(spark, [*queries, ("bad", [1.0]), ("null", None)]), "q", 6, probes=1, exact=True).collect()}
    assert got == brute(rows, queries, 6)
    assert sum(map(len, (r.keys for r in index.blocks.collect()))) == len(rows)


def test_approximate_search_on_clusters(spark):
    rows = clustered(1500)
    index = vectors.build(table(spark, rows), "key")
    queries = [(f"q{i}", rows[i * 15][1]) for i in range(100)]
    q = asked(spark, queries)
    truth = spark.createDataFrame([(a, b) for a, b, _, _ in brute(rows, queries, 5)], "q string, key string")
    assert vectors.recall(vectors.search(index, q, "q", 5, probes=8), truth, "q", "key") >= 0.9


def test_recall_on_the_given_table(spark, sf001):
    rows = spark.read.parquet(f"{sf001}/embeddings.parquet")
    q = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    index = vectors.build(rows, "vec_id")
    truth = search.knn_join(q, rows, "vec_id", "query_id", 5)
    assert vectors.recall(vectors.search(index, q, "query_id", 5, probes=16), truth, "query_id", "vec_id") >= 0.9


def test_threshold_search(spark):
    rows = clustered(400)
    index = vectors.build(table(spark, rows), "key", cells=10)
    queries = [(f"q{i}", rows[i * 9][1]) for i in range(12)]
    for t in (0.3, 0.9):
        want = {(q, k, s) for q, k, s, _ in brute(rows, queries, len(rows)) if s >= t}
        assert {(r.q, r.key, r.score + 0.0) for r in vectors.within(index, asked(spark, queries), "q", t).collect()} == want


def test_only_probed_cells_are_read(spark):
    rows = clustered(800)
    index = vectors.build(table(spark, rows), "key", cells=12)
    one = asked(spark, [("q", rows[0][1])]).withColumnRenamed("embedding", "v").withColumn("bound", F.lit(4.0))
    probed = vectors._probed(index, one, 2)
    cells = {r.cell for r in probed.collect()}
    assert len(cells) == 2
    plan = vectors._scan(index, probed, 3, -2.0)._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [", 1)[1].split("]", 1)[0]
    assert "cell" in filters and all(str(c) in filters for c in cells)


def test_empty_index_and_queries(spark):
    none = table(spark, []).where("false")
    index = vectors.build(none, "key")
    assert vectors.search(index, asked(spark, [("q", [1.0])]), "q", 3, exact=True).count() == 0
    full = vectors.build(table(spark, clustered(30)), "key")
    assert vectors.search(full, asked(spark, []), "q", 3, exact=True).count() == 0


def test_candidates_by_names_and_vectors_with_text_hits(spark):
    known = spark.createDataFrame([("f1", "Ada Byron", "Ada wrote programs", [1.0, 0.0]), ("f2", "Bern", "a city", [0.0, 1.0]), ("f3", "Ada Bryon", "misspelt Ada Byron", None)], "family_id string, name string, content string, embedding array<double>")
    rows = spark.createDataFrame([(1, "Ada Byron (poet)", [1.0, 0.1], [0.0, 1.0]), (2, "Zed", None, None), (3, "", None, None)], "pos int, name string, name_vector array<double>, full_vector array<double>")
    got = {(r.pos, r.family_id): (r.lexical_score, r.merge_safe) for r in resolution.entity_candidates(rows, known).collect()}
    assert got[1, "f1"] == (0.85, True) and not got[1, "f2"][1] and {p for p, _ in got} == {1}
    less = resolution.entity_candidates(rows, known).where("family_id <> 'f1'")
    more = {(r.pos, r.family_id): r.merge_safe for r in resolution.with_text_hits(less, rows, known, 0.3).collect()}
    assert more[1, "f1"] is False and more[1, "f2"] is False


@pytest.mark.parametrize("limit", [1, 3])
def test_many_queries_by_text_equal_single_ones(spark, limit):
    docs = spark.createDataFrame([("a", "red ring of red"), ("b", "blue ring"), ("c", None), ("d", "")], "id string, text string")
    queries = ["red ring", "ring", "none", "", "blue blue"]
    got = {tuple(r) for r in search.bm25_join(spark.createDataFrame([(q,) for q in queries], "query string"), docs, "query", "id", "text", limit).collect()}
    assert got == {(q, r.id, r.score) for q in queries for r in search.bm25(docs, "id", "text", q, limit).collect()}
