"""Name rules one by one, advice, findings and actions that can be repeated."""

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import name_rules as nr
from chronoloom.operators import upkeep

BROKEN = {
    "": "missing", "  ": "missing", None: "missing", "x": "too_short", "a name of this language that is longer than fifty signs": "too_long", "这是一个非常非常非常非常非常非常非常非常非常非常长的名字没有人会用": "too_long", "12345": "no_letter", "1984年": "only_a_date", "1984年5月3日（周四）": "only_a_date",
    "处理进度表": "machinery", "my token": "machinery", "json parser": "machinery", "abababab": "stutter", "玄德曰：善": "speech", "According to Ada": "speech", "Watch out!": "exclamation", "真的吗太好了！": "exclamation", "甲、乙": "list", "a, b, c, d": "list",
    "天下大势，分久必合": "sentence", "He came. He saw": "sentence", "北京大学的物理学家": "phrase", "some_name_here": "identifier", "张伟（他说，好）": "sentence", "张伟(甲：乙)": "note_is_a_sentence", "标题：引言": "heading", "how to win": "question", "the best method": "vague",
    "Building a bridge": "activity", "曹操病逝": "activity", "提高效率": "activity", "Research": "generic", "研究（topic）": "generic", "History of Rome": "aspect", "market analysis": "aspect",
}
VALID = ["Ada Lovelace", "李明教授", "太尉", "C++", "Grace Hopper (admiral)", " padded ", "naïve Bayes", "概念对齐", "Python", "1984 (novel by Orwell)"]


def test_every_rule_has_a_name_that_breaks_it(spark):
    rows = spark.createDataFrame([(n,) for n in [*BROKEN, *VALID]], "name string")
    got = {r.name: r.reason for r in rows.select("name", nr.first_broken("name").alias("reason")).collect()}
    assert got == BROKEN | {"1984 (novel by Orwell)": "only_a_date"} | dict.fromkeys(VALID[:-1])
    assert {r.reason for r in nr.RULES} == set(BROKEN.values())


def test_rules_are_data(spark):
    own = (nr.Rule("shout", "matches", "^[A-Z ]+$"), *nr.RULES)
    rows = spark.createDataFrame([("LOUD",), ("Ada",)], "name string")
    assert [r[0] for r in rows.select(nr.first_broken("name", own)).collect()] == ["shout", None]


def tables(spark):
    e = [("e1", "f1", "Ada", "Ada wrote\nprograms", False, None), ("e2", "f2", "Bern", "a city", False, "told"), ("e3", "f3", "x", "", False, None), ("e4", "f1", "Ada", "old", True, None), ("e5", "f5", "Ada (poet)", "text", False, None)]
    r = [("r1", "g1", "e1", "e2", "x", False), ("r2", "g2", "e1", "e1", "self", False), ("r3", "g3", "e2", "gone", "lost", False), ("r4", "g4", "e1", "e5", "ended", True)]
    at = F.when(F.col("ended"), F.lit("2024-01-01").cast("timestamp")).alias("invalid_at")
    ents = spark.createDataFrame(e, "id string, family_id string, name string, content string, ended boolean, summary string").select("id", "family_id", "name", "content", "summary", at)
    return ents, spark.createDataFrame(r, "id string, family_id string, entity1_id string, entity2_id string, content string, ended boolean").select("id", "family_id", "entity1_id", "entity2_id", "content", at)


EMPTY = "key string, action string, target string, op string, subject string, status string"


def test_health_advice_and_findings(spark):
    ents, rels = tables(spark)
    row = upkeep.health(ents, rels, rels.where("false")).first().asDict()
    assert row == {"entities": 4, "unsummarised": 3, "bad_names": 1, "relations": 3, "episodes": 0, "invalid_versions": 2, "isolated_entities": 2, "dangling_ends": 1, "communities": 0, "cycles": 0}
    got = [(r.action, r.priority) for r in upkeep.advice(upkeep.health(ents, rels, rels.where("false"))).collect()]
    assert got == [("mend_names", "high"), ("mend_ends", "high"), ("cleanup_isolated", "medium"), ("cleanup_invalidated", "medium"), ("run_dream", "medium"), ("evolve_summaries", "low")]
    found = {(r.kind, r.subject) for r in upkeep.findings(ents, rels).collect()}
    assert found == {("bad_name", "e3"), ("empty_content", "e3"), ("isolated_entity", "f3"), ("isolated_entity", "f5"), ("self_relation", "r2"), ("dangling_end", "r3"), ("shared_core_name", "f1"), ("shared_core_name", "f5")}


@pytest.mark.parametrize(("action", "ids", "links"), [("cleanup_isolated", {"e1", "e2", "e4"}, 4), ("cleanup_invalidated", {"e1", "e2", "e3", "e5"}, 3), ("mend_ends", {"e1", "e2", "e3", "e4", "e5"}, 3)])
def test_actions_done_once(spark, action, ids, links):
    ents, rels = tables(spark)
    log = spark.createDataFrame([], EMPTY)
    e, r, seen = upkeep.execute(action, ents, rels, log, dry_run=True)
    assert e.count() == 5 and r.count() == 4 and {x.status for x in seen.collect()} == {"preview"}
    e, r, log = upkeep.execute(action, ents, rels, log)
    assert {x.id for x in e.collect()} == ids and r.count() == links
    again = upkeep.execute(action, e, r, log)
    assert again[0].count() == len(ids) and again[2].count() == log.count()
    replay = upkeep.execute(action, ents, rels, log)  # the old tables with the new log: nothing is planned twice
    assert replay[2].count() == log.count()


def test_summaries_are_set_where_there_are_none(spark):
    ents, rels = tables(spark)
    e, _, log = upkeep.execute("evolve_summaries", ents, rels, spark.createDataFrame([], EMPTY))
    assert {x.id: x.summary for x in e.collect()} == {"e1": "Ada wrote", "e2": "told", "e3": "x", "e4": None, "e5": "text"}
    assert upkeep.execute("evolve_summaries", e, rels, log)[2].count() == log.count() == 3
    with pytest.raises(ValueError, match="unknown action"):
        upkeep.planned("none", ents, rels)
