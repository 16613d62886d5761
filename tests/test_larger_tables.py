"""Findings on larger tables: results against SQL or plain loops, and how little is made on the way."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom import queries as q
from chronoloom.functions import text as tx
from chronoloom.functions import validation as va
from chronoloom.operators import endpoints as en
from chronoloom.operators import reports as rp
from chronoloom.operators import resolution as rs
from chronoloom.operators import search as se
from chronoloom.operators import simjoin
from chronoloom.operators import upkeep as up
from chronoloom.plans.remember import capitalised
from chronoloom.operators import vectors as vx
from test_queries import canon


def on_tables(spark, folder, name, **tables):
    """A query and its SQL on tables of their own, made by SQL; the others are those of ``folder``."""
    con = duckdb.connect()
    for table, select in tables.items():
        con.execute(f"COPY ({select}) TO '{folder}/{table}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return canon(q.QUERIES[name](spark, str(folder)).toPandas()), canon(con.execute(q.ORACLES[name]).fetchdf())


def test_shortest_paths_in_the_order_of_their_text(spark, tmp_path, sf0001):
    rows = f"SELECT * REPLACE (1 + i % 2 AS l_partkey, 1 + i // 2 AS l_suppkey) FROM (SELECT *, row_number() OVER () - 1 AS i FROM '{sf0001}/lineitem.parquet' LIMIT 24)"
    got, want = on_tables(spark, tmp_path, "shortest_paths", lineitem=rows)
    assert got == want and len(got[1]) == 10


def sides(spark, n=60):
    left = spark.range(n).selectExpr("id % 3 AS digit", "concat('n', id % 4) AS left_name", "id % 7 / 10 AS score")
    return left, spark.range(n // 2).selectExpr("id % 3 AS digit", "CASE id % 5 WHEN 0 THEN concat('s', id % 6, ' (x)') ELSE concat('s', id % 6) END AS right_name", "id AS place")


def test_best_of_a_join_without_its_pairs(spark):
    left, right = sides(spark)
    none = spark.createDataFrame([(None, "n9", 0.5)], "digit long, left_name string, score double")
    want = rp.best_match(left.join(right, "digit"))
    few = rp.best_of_join(left.unionAll(none), right, "digit")
    assert sorted(map(tuple, rp.best_match(few).collect())) == sorted(map(tuple, want.collect())) and few.count() <= 12


def test_pairs_are_counted_and_repeated(spark):
    left, right = sides(spark)
    want = sorted(map(tuple, left.join(right, "digit").select("left_name", "right_name").collect()))
    counts = rp.pair_counts(left, right, "digit")
    assert sorted(map(tuple, rp.repeated(counts).collect())) == want and counts.count() < len(want) / 4
    assert rp.repeated(spark.createDataFrame([("a", 25_000), ("b", 1), ("c", 20_000)], "x string, n long")).groupBy("x").count().orderBy("x").collect() == [("a", 25_000), ("b", 1), ("c", 20_000)]


@pytest.mark.parametrize("scale", [1.0, 1e-5])
def test_nearest_over_shelves_equals_all_pairs(spark, scale):
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(90, 6)) * scale, np.zeros((2, 6)), np.ones((8, 6))])
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [1.0])], "key long, embedding array<double>")
    norm = np.sqrt((x * x).sum(1))
    score = np.round((x @ x.T) / (np.outer(norm, norm) + 1e-9), 6) + 0.0
    queries = rows.where("key % 9 = 0").withColumnRenamed("key", "q")
    for ties in (False, True):
        want = set()
        for a in range(0, 100, 9):
            ranked = sorted((-s, b) for b, s in enumerate(score[a]))
            want |= {(a, b, -s + 0.0) for i, (s, b) in enumerate(ranked) if i < 5 or (ties and s == ranked[4][0])}
        got = vx.nearest(queries, rows, "q", "key", 5, ties=ties, shelf_bytes=8 * 6 * 16)
        assert {(g.q, g.key, g.score) for g in got.collect()} == want
    got = vx.nearest(queries, rows, "q", "key", least=0.3, shelf_bytes=8 * 6 * 16)
    assert {(g.q, g.key) for g in got.collect()} == {(a, b) for a in range(0, 100, 9) for b in range(100) if score[a, b] >= 0.3}


def test_odd_vectors_have_their_place_among_the_nearest(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, None), (3, [1.0]), (4, [0.0, 1.0])], "key long, embedding array<double>")
    got = se.knn_join(rows.where("key in (0, 3)").withColumnRenamed("key", "q"), rows, "key", "q", 4)
    assert {(g.q, g.key, g.score) for g in got.collect()} == {(0, 0, 1.0), (0, 2, 0.0), (0, 3, 0.0), (0, 4, 0.0), (3, 3, 1.0), (3, 0, 0.0), (3, 1, 0.0), (3, 2, 0.0)}


def test_equally_near_names_of_an_end_by_rank(spark):
    raws = spark.createDataFrame([("q1", [1.0, 0.0]), ("q2", [0.0, -1.0])], "raw string, embedding array<double>")
    own = spark.createDataFrame([("alpha", [2.0, 0.0]), ("omega (x)", [1.0, 0.0]), ("other", [0.0, 1.0])], "name string, embedding array<double>")
    names = own.selectExpr("name", "1 AS place")
    got = en.resolved(raws, names, inside=False, vectors=(raws, own), nearest=0.5)
    assert {(r.raw, r.name, r.stage) for r in got.collect()} == {("q1", "omega (x)", "vector"), ("q2", None, "unknown")}


def test_best_names_by_falling_thresholds_equal_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simjoin, "FEW_MET", 0)
    names = [f"Supplier#{i:09d}" for i in range(0, 2400, 16)] + ["Supplier", "SUPPLIER#000000016", "red ring", "red rings", "Red Ring (old)", "zz"]
    d = spark.createDataFrame([(n,) for n in names], "name string")
    score = F.round(rs.name_score(F.col("left_name"), F.col("right_name")), 6)
    both = d.select(F.col("name").alias("left_name")).crossJoin(d.select(F.col("name").alias("right_name"))).withColumn("score", score).where("score >= 0.5")
    place = F.row_number().over(Window.partitionBy("left_name").orderBy(F.desc("score"), "right_name"))
    want = {tuple(r) for r in both.withColumn("rank", place).where("rank <= 5").collect()}
    assert {tuple(r) for r in rs.candidate_table(d, d, 0.5, 5).select("left_name", "right_name", "score", "rank").collect()} == want


@pytest.mark.parametrize(("lexical", "dense"), [(0.6, 0.4), (0.6, 0.6), (0.5, 0.8)])
def test_best_families_of_many_with_one_name_equal_all_pairs(spark, lexical, dense):
    r = np.random.default_rng(7)
    known = spark.createDataFrame([(f"f{i}", ["red ring", "red rings", "blue ring", "Ada"][i % 4], r.normal(size=3).tolist() if i % 9 else None) for i in range(120)], "family_id string, name string, embedding array<double>")
    mine = spark.createDataFrame([(i, ["RED RING", "ring", "Ada (x)", "nobody", "old red ring"][i % 5], r.normal(size=3).tolist(), r.normal(size=3).tolist() if i % 4 else None) for i in range(20)], "pos long, name string, name_vector array<double>, full_vector array<double>")
    pairs = mine.crossJoin(known.withColumnRenamed("name", "known_name"))
    pairs = pairs.withColumn("lexical_score", F.round(rs.name_score(F.col("name"), F.col("known_name")), 6)).withColumn("dense_score", F.round(F.greatest(tx.cosine("name_vector", "embedding"), tx.cosine("full_vector", "embedding")), 6))
    pairs = pairs.where((F.col("lexical_score") >= lexical) | (F.col("dense_score") >= dense)).withColumn("score", F.greatest("lexical_score", "dense_score"))
    place = F.row_number().over(Window.partitionBy("pos").orderBy(F.desc("score"), "family_id"))
    columns = ["pos", "family_id", "lexical_score", "dense_score", "score", "rank"]
    want = {tuple(x) for x in pairs.withColumn("rank", place).where("rank <= 10").select(*columns).collect()}
    assert {tuple(x) for x in rs.entity_candidates(mine, known, lexical, dense).select(*columns).collect()} == want


def test_names_of_a_window_have_contents_by_its_sentences_cut_once(spark):
    text = "# Ada head\nAda wrote the first program! Then Bob came\nshort\nEvery one met Éva and Bob? Ada again。Ada rested in the long afternoon"
    chunks = spark.createDataFrame([(1, 0, text), (1, 1, ""), (2, 0, "no names")], "key long, window int, chunk string")
    entities = capitalised(chunks)[0]
    said = va.spoken("chunk")
    assert chunks.select(said).first()[0] == ["Ada wrote the first program! Then Bob came", "Every one met Éva and Bob? Ada again", "Ada rested in the long afternoon"]
    names = ["Ada", "Then", "Bob", "Every", "Éva"]
    rows = chunks.where("key = 1 and window = 0").crossJoin(spark.createDataFrame([(n,) for n in names], "name string"))
    want = {tuple(r) for r in rows.select("name", va.fallback_content("name", "chunk")).collect()}
    assert {(r.name, r.content) for r in entities.collect()} == want and entities.count() == 5


def test_the_best_of_many_names_around_a_short_one(spark):
    left = spark.createDataFrame([("ring",), ("RING (old)",)], "name string")
    right = spark.createDataFrame([("a" * (1 + i % 30) + f" ring {i:03d}", f"f{i:03d}") for i in range(200)], "name string, family_id string")
    pairs = simjoin.name_pairs(left, right, 0.6, 5, rank="family_id")
    score = F.round(rs.name_score(F.col("left_name"), F.col("right_name")), 6)
    every = left.withColumnRenamed("name", "left_name").crossJoin(right.withColumnRenamed("name", "right_name")).withColumn("score", score).where("score >= 0.6")
    place = F.row_number().over(Window.partitionBy("left_name").orderBy(F.desc("score"), "family_id"))
    best = lambda rows: {tuple(r) for r in rows.withColumn("_r", place).where("_r <= 5").select("left_name", "right_name", "score").collect()}
    found = pairs.distinct()
    assert best(found.join(right.withColumnRenamed("name", "right_name"), "right_name").withColumn("score", score)) == best(every)
    assert found.count() <= 20 and every.count() == 400


def test_an_action_leaves_other_tables_as_they_came(spark):
    entities = spark.createDataFrame([("a1", "a", None), ("b1", "b", None)], "id string, family_id string, invalid_at timestamp")
    relations = spark.createDataFrame([("r1", "ab", "a1", "a1", None), ("r2", "ac", "a1", "c1", None)], "id string, family_id string, entity1_id string, entity2_id string, invalid_at timestamp")
    log = spark.createDataFrame([], "key string, action string, target string, op string, subject string, status string")
    same, mended, log = up.execute("mend_ends", entities, relations, log)
    assert same is entities and [r.id for r in mended.collect()] == ["r1"]
    left, same, log = up.execute("cleanup_isolated", entities, mended, log)
    assert same is mended and [r.id for r in left.collect()] == ["a1"]
    assert [(r.action, r.subject) for r in log.orderBy("subject").collect()] == [("cleanup_isolated", "b1"), ("mend_ends", "r2")]
