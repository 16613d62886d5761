"""Stages of the unified find that the registered queries don't reach."""

import pytest

from chronoloom.operators.unified import find

NOW = "2024-02-01 00:00:00"


def tables(spark):
    ents = [("e1", "f1", "red ring (old)", "red thing", "2024-01-10"), ("e2", "f2", "blue ring", "blue thing", "2024-01-20"), ("e3", "f3", "green", "nothing", None), ("e4", "f4", "red", "far", "2024-01-01"), ("e5", "f5", "lone red ring", "red red", "2024-01-05")]
    entities = spark.createDataFrame(ents, "id string, family_id string, name string, content string, at string").selectExpr("id", "family_id", "name", "content", "cast(at as timestamp) as event_time", "0.5D as confidence")
    rels = [("r1", "g1", "e1", "e2", "red holds blue", "2024-01-11"), ("r2", "g2", "e2", "e3", "beside", "2024-01-12"), ("r3", "g3", "e3", "e4", "same words", "2024-01-13"), ("r4", "g4", "e2", "e4", "beside", "2024-01-14"), ("r5", "g5", "e9", "e4", "", "2024-01-15")]
    relations = spark.createDataFrame(rels, "id string, family_id string, entity1_id string, entity2_id string, content string, at string").selectExpr("*", "cast(at as timestamp) as event_time", "cast(at as timestamp) as processed_time", "0.5D as confidence", "cast(null as string) as attributes")
    return entities, relations


def found(rows):
    return {(r.kind, r.family_id): (r.score, r.place) for r in rows.collect()}


def test_completion_expansion_and_deduplication(spark):
    e, r = tables(spark)
    got = found(find(e, r, "red ring", NOW))
    assert {f for k, f in got if k == "entity"} == {"f1", "f2", "f3", "f4", "f5"}
    assert got["entity", "f1"][1] == 1  # the core name is the query
    assert 0 < got["entity", "f2"][0] < got["entity", "f1"][0]  # an end of a recalled relation
    assert {f for k, f in got if k == "relation"} >= {"g1"} and len({"g2", "g4"} & {f for _, f in got}) == 1  # equal contents
    less = found(find(e, r, "red ring", NOW, expand=False))
    assert {f for k, f in less if k == "relation"} == {"g1"}


def test_times_modes_and_rerankers(spark):
    e, r = tables(spark)
    got = found(find(e, r, "red ring", NOW, since="2024-01-08", until="2024-01-12"))
    assert {f for k, f in got if k == "entity"} == {"f1", "f3"} and {f for k, f in got if k == "relation"} <= {"g1", "g2"}
    plain = found(find(e, r, "red", NOW, mode="bm25"))
    assert all(s == 0 for s, _ in plain.values()) and ("entity", "f1") in plain and plain["entity", "f4"][1] == 1  # by its exact name
    hits = spark.createDataFrame([("f3", 0.9)], "family_id string, score double")
    near = found(find(e, r, "anything at all that is long", NOW, mode="semantic", entity_hits=hits, relation_hits=hits.where("false")))
    assert ("entity", "f3") in near and ("relation", "g2") in near
    ranked = found(find(e, r, "red ring", NOW, reranker="node_degree"))
    assert ranked["entity", "f2"][0] > ranked["entity", "f3"][0]
    assert found(find(e, r, " ", NOW)) == {}
    assert len([k for k in found(find(e, r, "red ring", NOW, max_entities=2)) if k[0] == "entity"]) == 2
    with pytest.raises(ValueError, match="unknown mode"):
        find(e, r, "x", NOW, mode="none")
