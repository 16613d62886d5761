"""Unified find: entities and relations that a query recalls, completed, expanded, filtered by time and ranked, as one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import core_name
from chronoloom.operators import search as se
from chronoloom.operators.relations import degrees
from chronoloom.operators.retrieval import HALF_LIFE, search_relations, visible
from chronoloom.plans.materialize import materialize

# How much of a relation's score its missing ends get, and of an end's score its further relations; lengths of a query that may be a name.
TO_ENDS, TO_RELATIONS, SHORT = 0.5, 0.3, (2, 20)
#: Names by prefix that are added where no recalled name is the query's.
BY_PREFIX = 3
#: Characters of a content in which two relations must differ.
SAME_CONTENT = 60


def _names_it(query: str):
    name = F.col("name")
    return (core_name("name") == query) | (name == query) | name.startswith(query + "（") | name.startswith(query + "(")


def find(
    entities: DataFrame, relations: DataFrame, query: str, now: str, mode: str = "hybrid", entity_hits: DataFrame | None = None, relation_hits: DataFrame | None = None,
    max_entities: int = 20, max_relations: int = 50, expand: bool = True, since: str | None = None, until: str | None = None, reranker: str = "rrf",
) -> DataFrame:
    """``kind``, ``family_id``, ``score`` and ``place`` of entities and relations, in seven stages.

    ``entities`` are newest rows (``id``, ``family_id``, ``name``, ``content``,
    ``event_time``, ``confidence``); ``relations`` are versions whose ends name
    such ids.  The hits (``family_id``, ``score``) are vector hits for the modes
    ``hybrid`` and ``semantic``; the mode ``bm25`` recalls by text alone, with
    scores of zero before the boost by name.  An empty query finds nothing.
    """
    links = materialize(visible(relations), "find-relations")
    query = query.strip()
    if mode == "hybrid":
        hits = se.hybrid(entities, query, entity_hits, None, max_entities)
        told = search_relations(relations, query, relation_hits, max_relations)
    elif mode == "bm25":
        hits = se.bm25(entities, "family_id", "content", query, max_entities).withColumn("score", F.lit(0.0))
        told = se.bm25(links, "family_id", "content", query, max_relations).withColumn("score", F.lit(0.0))
    elif mode == "semantic":
        best = lambda rows, n: rows.orderBy(F.desc("score"), "family_id").limit(n).select("family_id", F.lit(0.0).alias("score"))
        hits, told = best(entity_hits, max_entities), best(relation_hits, max_relations)
    else:
        raise ValueError(f"unknown mode: {mode}")
    if not query:
        hits, told = hits.where("false"), told.where("false")
    hits = materialize(hits.select("family_id", F.col("score").cast("double").alias("score")), "find-hits")
    told = materialize(told.select("family_id", F.col("score").cast("double").alias("score")), "find-told")
    own = entities.select("id", "family_id", "name", "event_time", "confidence")
    if SHORT[0] <= len(query) <= SHORT[1]:
        state = hits.join(own, "family_id").agg(F.count("*").alias("_n"), F.count_if(_names_it(query)).alias("_named"))
        more = own.where(F.col("name").startswith(query)).join(hits.select("family_id"), "family_id", "left_anti").select("family_id").distinct().orderBy("family_id").limit(BY_PREFIX)
        hits = hits.unionByName(more.join(F.broadcast(state)).where("_n > 0 and _named = 0").select("family_id", F.lit(0.0).alias("score")))

    ids = own.select("id", "family_id")
    ends = links.select(F.col("family_id").alias("relation"), F.explode(F.array_distinct(F.array("entity1_id", "entity2_id"))).alias("id")).join(ids, "id").select("relation", "family_id")
    ends = materialize(ends.distinct(), "find-ends")
    met = told.select(F.col("family_id").alias("relation"), F.col("score").alias("s")).join(ends, "relation").groupBy("family_id").agg((F.max("s") * TO_ENDS).alias("score"))
    every = materialize(hits.unionByName(met.join(hits.select("family_id"), "family_id", "left_anti")), "find-entities")
    if expand:
        near = ends.join(every, "family_id").groupBy("relation").agg((F.max("score") * TO_RELATIONS).alias("score")).withColumnRenamed("relation", "family_id")
        newest = near.join(links.select("family_id", "processed_time", "id"), "family_id").orderBy(F.desc("processed_time"), F.desc("id")).limit(max_relations)
        wider = materialize(newest.join(told.select("family_id"), "family_id", "left_anti").select("family_id", "score"), "find-wider")
        beyond = ends.join(wider.select(F.col("family_id").alias("relation")), "relation").select("family_id").distinct().join(every.select("family_id"), "family_id", "left_anti")
        every, told = every.unionByName(beyond.withColumn("score", F.lit(0.0))), told.unionByName(wider)

    def within(rows: DataFrame) -> DataFrame:
        for bound, keeps in ((since, lambda t: F.col("event_time") >= t), (until, lambda t: F.col("event_time") <= t)):
            if bound:
                rows = rows.where(F.col("event_time").isNull() | keeps(F.lit(bound).cast("timestamp")))
        return rows

    found = within(every.join(own, "family_id"))
    lines = within(told.join(links.select("family_id", "content", "event_time", "confidence"), "family_id"))
    if reranker == "node_degree":
        edges = ends.select("family_id", "relation").alias("a").join(ends.alias("b"), "relation").where("a.family_id < b.family_id").select(F.col("a.family_id").alias("fam1"), F.col("b.family_id").alias("fam2"))
        found = se.degree_rerank(found, degrees(edges))
    else:
        found, lines = (se.confidence_rerank(rows, now, half_life_days=HALF_LIFE) for rows in (found, lines))
    found = found.orderBy(F.desc("score"), "family_id").limit(max_entities)
    lines = lines.orderBy(F.desc("score"), "family_id").limit(max_relations)
    first = _names_it(query) if SHORT[0] <= len(query) <= SHORT[1] else F.lit(False)
    said = F.trim(F.substring(F.coalesce("content", F.lit("")), 1, SAME_CONTENT))
    again = F.row_number().over(Window.partitionBy("_said").orderBy(F.desc("score"), "family_id"))
    lines = lines.withColumn("_said", said).withColumn("_again", again).where("_said = '' or _again = 1")
    placed = lambda rows, kind, *order: rows.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(kind)).orderBy(*order))).select(F.lit(kind).alias("kind"), "family_id", "score", "place")
    # both lists hold a stated number of rows at most
    return placed(found.withColumn("_first", first), "entity", F.desc("_first"), F.desc("score"), "family_id").unionByName(placed(lines, "relation", F.desc("score"), "family_id"))
