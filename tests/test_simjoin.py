"""Similarity joins against all pairs, and how few pairs they look at."""

import random
import time

import pytest
from pyspark.sql import functions as F

from chronoloom.functions.text import char_grams
from chronoloom.operators import resolution, simjoin

ODD = ["red ring", "red rings", "ring red", "blue ring", "Bob (x)", "Bob", "bob", "BOB (y)", "zz", "a", "A", "ab", "aa", "", "(x)", "  ", "abc", "bca", "a b", "red ring (old)", "ring", "éa", "李明", "李明华", "李", "李(教授)"]


def names():
    r = random.Random(3)
    return ODD + ["".join(r.choice("abc ") for _ in range(r.randrange(2, 12))) for _ in range(80)]


def frame(spark, rows):
    return spark.createDataFrame([(n,) for n in rows], "name string")


@pytest.mark.parametrize("threshold", [0.5, 0.6, 0.65, 0.7, 0.85, 0.9])
def test_name_candidates_equal_all_pairs(spark, threshold):
    d = frame(spark, names()).distinct()
    both = d.select(F.col("name").alias("left_name")).crossJoin(d.select(F.col("name").alias("right_name")))
    score = F.round(resolution.name_score(F.col("left_name"), F.col("right_name")), 6)
    want = {tuple(r) for r in both.withColumn("score", score).where(F.col("score") >= threshold).collect()}
    got = {(r.left_name, r.right_name, r.score) for r in resolution.candidate_table(d, d, threshold, 10**6).collect()}
    assert got == want
    by_left = {}
    for a, b, s in want:
        by_left.setdefault(a, []).append((-s, b))
    best = {(a, b, -s) for a, hits in by_left.items() for s, b in sorted(hits)[:2]}
    assert {(r.left_name, r.right_name, r.score) for r in resolution.candidate_table(d, d, threshold, 2).collect()} == best


def test_two_sides_nulls_repeats_and_empty(spark):
    left, right = frame(spark, ["red ring", None, "red ring", "x"]), frame(spark, ["red rings", None, "X"])
    assert {(r.left_name, r.right_name) for r in resolution.candidate_table(left, right, 0.5).collect()} == {("red ring", "red rings"), ("x", "X")}
    assert resolution.candidate_table(left.where("false"), right).count() == 0
    assert resolution.candidate_table(left, right.where("false")).count() == 0


@pytest.mark.parametrize("most", [1, 3, 2000])
def test_sets_in_slices_equal_all_pairs(spark, most):
    r = random.Random(5)
    sets = [(i, sorted({f"t{int(r.expovariate(0.15))}" for _ in range(r.randrange(1, 12))})) for i in range(150)]
    d = spark.createDataFrame(sets, "id int, tokens array<string>")
    for t in (0.5, 0.8):
        want = {(i, j) for i, a in sets for j, b in sets if len(set(a) & set(b)) / len(set(a) | set(b)) >= t}
        rows = simjoin.overlap_join(d, d, t, most).collect()
        assert {(x.left_id, x.right_id) for x in rows} == want and len(rows) == len(want)


@pytest.mark.parametrize("ratio", [0.0, 0.6])
def test_containment_equals_all_pairs(spark, ratio):
    texts = sorted({n for n in names() if n})
    d = spark.createDataFrame([(t, t) for t in texts], "id string, text string")
    want = {(a, b) for a in texts for b in texts if a in b and len(a) >= ratio * len(b)}
    for most in (2, 2000):
        rows = simjoin.containment_join(d, d, ratio, most).collect()
        assert {(x.short_id, x.long_id) for x in rows} == want and len(rows) == len(want)


def test_a_common_bigram_is_not_joined(spark):
    """Three thousand names with one bigram: nine million pairs share it, few are looked at."""
    d = frame(spark, [f"ab{i}" for i in range(3000)])
    sets = d.select(F.col("name").alias("id"), char_grams(F.col("name"), 2).alias("tokens"))
    assert simjoin.overlap_candidates(sets, sets, 0.8).count() < 200_000
    assert simjoin.overlap_candidates(sets, sets, 0.6).count() < 400_000
    start = time.perf_counter()
    simjoin.overlap_join(sets, sets, 0.8).count()
    assert time.perf_counter() - start < 20


def test_groups_of_similar_contents(spark):
    r = random.Random(9)
    rows = [(f"i{k}", "".join(r.sample("abcdefgh", r.randrange(0, 7)))) for k in range(60)] + [("n", None), ("m", " ")]
    d = spark.createDataFrame(rows, "id string, content string")
    sets = {i: frozenset((c or "").strip()) for i, c in rows}
    group = {i: i for i in sets}
    for _ in sets:
        for i, a in sets.items():
            for j, b in sets.items():
                if a == b or (a and b and len(a & b) / len(a | b) > 0.65):
                    group[i] = group[j] = min(group[i], group[j])
    got = {x.id: x.group for x in resolution.similar_contents(d, 0.65).collect()}
    parts = lambda g: {frozenset(k for k in g if g[k] == v) for v in g.values()}
    assert parts(got) == parts(group)
