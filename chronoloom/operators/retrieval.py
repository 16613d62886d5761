"""Search over relations and concepts, quick search, expansion with relations and question routes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators import concepts as co
from chronoloom.operators import graph as gr
from chronoloom.operators import search as se
from chronoloom.operators.temporal import as_of_valid, latest

HALF_LIFE = 90.0


def latest_concepts(rows: DataFrame, role: str | None = None, t: Column | str | None = None) -> DataFrame:
    """Newest version of each family, valid at a time where one is given, without open hypotheses."""
    own = rows if role is None else rows.where(F.col("role") == role)
    now = as_of_valid(own, t) if t is not None else latest(own)
    return now.where(~co.hidden_hypothesis())


def concepts_by_text(rows: DataFrame, query: str, role: str | None = None, limit: int = 20, t: Column | str | None = None) -> DataFrame:
    """BM25 over the concepts' contents."""
    return se.bm25(latest_concepts(rows, role, t), "family_id", "content", query, limit)


def concepts_by_vector(rows: DataFrame, vector: list[float], query: str, role: str | None = None, threshold: float = 0.5, limit: int = 10, t: Column | str | None = None) -> DataFrame:
    """Nearest concepts by cosine; where none reaches the threshold, BM25."""
    near = latest_concepts(rows, role, t).where("embedding is not null")
    hits = se.knn(near, vector, "family_id", "embedding", limit, threshold).withColumn("way", F.lit("vector"))
    found = hits.agg(F.count("*").alias("_n"))
    text = concepts_by_text(rows, query, role, limit, t).withColumn("way", F.lit("text"))
    return hits.unionByName(text.join(F.broadcast(found)).where("_n = 0").drop("_n"))


def hybrid_concepts(rows: DataFrame, query: str, vector_hits: DataFrame, role: str | None = None, limit: int = 20, t: Column | str | None = None) -> DataFrame:
    """Rank fusion of twice as many text and vector hits, sums as they are."""
    text = se.ranked(concepts_by_text(rows, query, role, 2 * limit, t))
    both = se.fuse([(text, se.BM25_WEIGHT), (se.ranked(vector_hits.orderBy(F.desc("score"), "family_id").limit(2 * limit)), se.VECTOR_WEIGHT)], normalise=False)
    return both.orderBy(F.desc("score"), "family_id").limit(limit)


def visible(relations: DataFrame, include_candidates: bool = False) -> DataFrame:
    """Newest relations, without open candidates unless they are asked for."""
    now = latest(relations)
    if include_candidates:
        return now
    get = lambda k: F.get_json_object("attributes", f"$.{k}")
    return now.where(~F.coalesce((get("tier") == "candidate") & (F.coalesce(get("status"), F.lit("")) != "verified"), F.lit(False)))


def search_relations(relations: DataFrame, query: str, vector_hits: DataFrame | None = None, top_k: int = 20, include_candidates: bool = False) -> DataFrame:
    """Relation search by text, fused with vector hits where there are any."""
    arms = [(se.ranked(se.bm25(visible(relations, include_candidates), "family_id", "content", query, 2 * top_k)), se.BM25_WEIGHT)]
    if vector_hits is not None:
        arms.append((se.ranked(vector_hits), se.VECTOR_WEIGHT))
    return se.fuse(arms).orderBy(F.desc("score"), "family_id").limit(top_k)


def find_relations(relations: DataFrame, query: str, now: str, mode: str = "text", top_k: int = 20, vector_hits: DataFrame | None = None) -> DataFrame:
    """Relation hits of one mode (``text``, ``vector`` or ``hybrid``), reranked by confidence and age.

    Outside the hybrid mode a hit's score is one less a hundredth for each place.
    """
    if mode == "hybrid":
        hits = search_relations(relations, query, vector_hits, top_k)
    else:
        found = se.bm25(visible(relations), "family_id", "content", query, top_k) if mode == "text" else vector_hits.orderBy(F.desc("score"), "family_id").limit(top_k)
        hits = se.ranked(found).select("family_id", (1 - F.col("rank") * 0.01).alias("score"))
    rows = hits.join(visible(relations).select("family_id", "confidence", "event_time"), "family_id")
    return se.confidence_rerank(rows, now, half_life_days=HALF_LIFE).select("family_id", "score").orderBy(F.desc("score"), "family_id")


def quick_search(entities: DataFrame, relations: DataFrame, query: str, now: str, limit: int = 10) -> DataFrame:
    """Entities of exactly the asked name first, then hybrid hits, then relations: ``kind``, ``family_id``, ``score``."""
    exact = latest(entities).where(F.lower("name") == query.lower()).select(F.lit("exact").alias("kind"), "family_id", F.lit(1.0).alias("score"))
    exact = exact.orderBy("family_id").limit(limit)
    hits = se.hybrid(latest(entities), query, None, None, limit).join(latest(entities).select("family_id", "confidence", "event_time"), "family_id")
    near = se.confidence_rerank(hits, now).select(F.lit("entity").alias("kind"), "family_id", "score").join(exact.select("family_id"), "family_id", "left_anti")
    links = find_relations(relations, query, now, "hybrid", limit).withColumn("kind", F.lit("relation"))
    return exact.unionByName(near.select("kind", "family_id", "score")).unionByName(links.select("kind", "family_id", "score"))


def reach_with_relations(edges: DataFrame, seeds: DataFrame, max_depth: int = 2, max_nodes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Visited nodes with their hop, and the relations (``id``, ``fam1``, ``fam2``) that led on: both ends visited, one before the last hop."""
    nodes = gr.bfs(edges.select(F.col("fam1").alias("u"), F.col("fam2").alias("v")), seeds, max_depth, max_nodes)
    hop = lambda end: nodes.select(F.col("id").alias(end), F.col("hop").alias(f"_{end}"))
    led = edges.select("id", "fam1", "fam2").join(hop("fam1"), "fam1").join(hop("fam2"), "fam2").where(F.least("_fam1", "_fam2") < max_depth)
    return nodes, led.select("id", "fam1", "fam2")


def ask(entities: DataFrame, edges: DataFrame, query: str, route: str, now: str, seeds: int = 3, most: int = 20) -> DataFrame:
    """Answers of a route: ``traverse`` walks from the best text hits, others search entities and relations."""
    if route == "traverse":
        start = se.bm25(latest(entities), "family_id", "content", query, seeds).select(F.col("family_id").alias("id"))
        nodes, _ = reach_with_relations(edges, start, 2, most)
        return nodes.select(F.lit("entity").alias("kind"), F.col("id").alias("family_id"), (F.lit(1.0) / (1 + F.col("hop"))).alias("score"))
    return quick_search(entities, edges, query, now, most)


def recent(entities: DataFrame, relations: DataFrame, limit: int = 10) -> DataFrame:
    """Newest families of both tables."""
    top = lambda df, kind: latest(df).orderBy(F.desc("processed_time"), F.desc("id")).limit(limit).select(F.lit(kind).alias("kind"), "family_id", "id", "processed_time")
    return top(entities, "entity").unionAll(top(relations, "relation"))


def candidate_ids(entities: DataFrame, name: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Families whose newest row matches a part of a name and a range of event times."""
    rows = latest(entities)
    if name:
        rows = rows.where(F.contains(F.lower("name"), F.lit(name.lower())))
    if since:
        rows = rows.where(F.col("event_time") >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.where(F.col("event_time") <= F.lit(until).cast("timestamp"))
    return rows.select("family_id")
