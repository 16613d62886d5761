import datetime as dt

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import proposals as pr

NOW = "2024-05-01 00:00:00"
ENT = "id string, family_id string, name string, processed_time timestamp, confidence double, invalid_at timestamp"
REL = "id string, family_id string, entity1_id string, entity2_id string, fam1 string, fam2 string, content string, confidence double, attributes string, processed_time timestamp, invalid_at timestamp"
CLOSED = "source_family_id string, target_family_id string"
DAY = [dt.datetime(2024, 1, d) for d in range(1, 9)]


def frames(spark):
    ents = [("a1", "a", "Old", DAY[0], 0.9, None), ("a2", "a", "Zoe", DAY[2], 0.9, None), ("b1", "b", "Bob", DAY[1], 0.2, None), ("c1", "c", "Cy", DAY[1], None, None)]
    rels = [
        ("r1", "r", "a1", "b1", "a", "b", "first", 0.4, '{"tier":"candidate","x":"1"}', DAY[3], None),
        ("r2", "r", "a1", "b1", "a", "b", "met", None, '{"tier":"candidate","additional_dream_cycles":"c0"}', DAY[4], None),
        ("q1", "q", "a2", "c1", "a", "c", "gone", 0.9, None, DAY[4], DAY[5]),
    ]
    return spark.createDataFrame(ents, ENT), spark.createDataFrame(rels, REL), spark.createDataFrame([("b_old", "b"), ("z", "nobody")], CLOSED)


def test_proposals_merge_create_or_refuse(spark):
    ents, rels, closed = frames(spark)
    pairs = spark.createDataFrame(
        [("b_old", "a", "met", 0.6), ("a", "b", "work together", 0.3), ("a", "b", "work together", 0.1), ("a", "b", None, None), ("c", "a", "again", 0.9), ("c", "a", "more", 0.95), ("z", "a", "x", 0.5)],
        "entity1_id string, entity2_id string, content string, confidence double",
    )
    out = {(r.fam1, r.fam2): r for r in pr.save(pairs, ents, rels, closed, "c9", NOW).withColumn("cycles", F.get_json_object("attributes", "$.additional_dream_cycles")).collect()}
    m, c, u = out["a", "b"], out["a", "c"], out["a", "nobody"]
    assert (m.action, m.family_id, m.entity1_id, m.confidence, m.cycles) == ("merged", "r", "a1", 0.6, "c0,c9")
    assert m.content == "met\n[Dream update] work together\n[Dream update] "
    # The only relation of c is over, so its pair starts anew; the end whose name sorts first comes first.
    assert (c.action, c.entity1_id, c.entity2_id, c.confidence) == ("created", "c1", "a2", 0.5) and c.family_id.startswith("rel_")
    assert c.content == "more\n[Dream update] again"
    assert u.action == "unknown" and u.id is None and u.content is None
    assert pr.save(pairs.where("false"), ents, rels, closed, "c9", NOW).count() == 0
    assert {r.action for r in pr.save(pairs, ents, rels.where("false"), closed, "c9", NOW).collect()} == {"created", "unknown"}


def test_saving_again_only_notes_the_cycle(spark):
    ents, rels, closed = frames(spark)
    pairs = spark.createDataFrame([("a", "c", "new", 0.4)], "entity1_id string, entity2_id string, content string, confidence double")
    one = pr.save(pairs, ents, rels, closed, "c1", NOW)
    rels = rels.unionByName(one.drop("action", "event_time", "source_document", "valid_at"), allowMissingColumns=True)
    two = pr.save(pairs, ents, rels, closed, "c2", "2024-05-02 00:00:00").first()
    assert (two.action, two.content, two.confidence, two.family_id) == ("merged", "new", 0.4, one.first().family_id) and two.id != one.first().id


def test_seeds_are_cut_before_the_limit(spark):
    ents, rels, _ = frames(spark)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "family_id string")
    got = lambda s, n=2, **k: [tuple(r) for r in pr.seeds(s, ents, rels, n, now=NOW, **k).collect()]
    assert got("hub", 1) == [("a", "hub")] and got("hub", 1, exclude=ids("a", "a")) == [("b", "hub")]
    assert got("low_confidence") == [("b", "low_confidence")] and got("low_confidence", members=ids("a")) == []
    assert {f for f, _ in got("time_gap", 9, exclude=ids("c"))} == {"a", "b"}
    assert len(got("random", 2, members=ids("a", "c"))) == 2
    assert got("cross_community", exclude=ids("a", "b", "c")) == []
    with pytest.raises(ValueError):
        got("dice")
    with pytest.raises(ValueError):
        pr.seeds("time_gap", ents, rels, 1)


def test_asked_ids(spark):
    ents, _, closed = frames(spark)
    asked = spark.createDataFrame([("b_old",), ("b",), ("b",), ("a",), ("z",), (None,)], "asked string")
    assert sorted((r.asked, r.id) for r in pr.by_asked_ids(ents, asked, closed).collect()) == [("a", "a2"), ("b", "b1"), ("b_old", "b1")]
