"""Retrieval: BM25 over an inverted index, vectors, string similarity, rank fusion and reranking."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import bleu, core_name, cosine, jaccard, sequence_ratio
from chronoloom.operators import vectors as vx
from chronoloom.plans.materialize import materialize

K1, B = 1.2, 0.75
# Rank constant and arm weights of the fusion.
RRF_K, VECTOR_WEIGHT, BM25_WEIGHT, GRAPH_WEIGHT = 60, 0.7, 0.3, 0.15


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def inverted_index(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``key``, ``term``, ``tf``, ``size``: one row for each distinct term of a document, with its length in terms.

    A document's words stand together, so most are counted before the shuffle.
    """
    words = docs.select(F.col(key), terms(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    every = words.select(key, F.size("_w").alias("size"), F.explode("_w").alias("term"))
    return every.groupBy(key, "size", "term").agg(F.count("*").alias("tf")).select(key, "term", "tf", "size")


def bm25(docs: DataFrame, key: str, text: str, query: str, limit: int | None = 20) -> DataFrame:
    """Okapi BM25 of documents that hold a term of the query.

    The query's terms are counted in one pass over each text; document
    frequencies and the average length come from one small aggregate.
    """
    wanted = sorted(set(_query_terms(query)))
    if not wanted:
        return docs.select(key).where("false").withColumn("score", F.lit(0.0))
    words = docs.select(F.col(key), terms(F.coalesce(F.col(text), F.lit(""))).alias("_w"))
    counted = words.select(key, F.size("_w").alias("_n"), *[_count("_w", t).alias(f"_t{i}") for i, t in enumerate(wanted)])
    stats = counted.agg(F.count("*").alias("_docs"), F.avg("_n").alias("_avg"), *[F.count_if(F.col(f"_t{i}") > 0).alias(f"_d{i}") for i in range(len(wanted))])
    rows = counted.where(" or ".join(f"_t{i} > 0" for i in range(len(wanted)))).join(F.broadcast(stats))
    score = F.lit(0.0)
    for i in range(len(wanted)):
        tf, df = F.col(f"_t{i}"), F.col(f"_d{i}")
        idf = F.log(1 + (F.col("_docs") - df + 0.5) / (df + 0.5))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.col("_n") / F.col("_avg")))
    out = rows.select(key, F.round(score, 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def stored_index(docs: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings and one row of totals, written once for many queries; ``key`` names a row.

    Postings lie in ranges of term and key, so a query skips the files and row
    groups of other terms, and a very frequent term takes several files.
    """
    postings = inverted_index(docs, key, text).repartitionByRange("term", key).sortWithinPartitions("term", key)
    postings = materialize(postings, "postings")
    words = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_words"))
    totals = docs.agg(F.count("*").alias("_docs")).join(F.broadcast(words)).select("_docs", (F.col("_words") / F.nullif("_docs", F.lit(0))).alias("_avg"))
    return postings, materialize(totals, "totals")


def bm25_stored(index: tuple[DataFrame, DataFrame], key: str, query: str, limit: int | None = 20) -> DataFrame:
    """The ranking of ``bm25`` from a stored index; texts aren't read."""
    postings, totals = index
    hits = postings.where(F.col("term").isin(sorted(set(_query_terms(query)))))
    often = hits.groupBy("term").agg(F.count("*").alias("_df"))  # one row for each term of the query
    rows = hits.join(F.broadcast(often), "term").join(F.broadcast(totals))
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("_avg")))
    out = rows.groupBy(key).agg(F.round(F.sum(part), 6).alias("score"))
    return out.orderBy(F.desc("score"), key).limit(limit) if limit else out


def bm25_join(queries: DataFrame, docs: DataFrame, query: str, key: str, text: str, limit: int) -> DataFrame:
    """The first ``limit`` documents by BM25 for every distinct query text, all queries in one join over one inverted index: ``query``, ``key``, ``score``.

    Terms of a query count once; a query without terms finds nothing.
    """
    postings = materialize(inverted_index(docs, key, text), "postings")
    often = postings.groupBy("term").agg(F.count("*").alias("_df"))
    words = postings.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("_words"))
    totals = docs.agg(F.count("*").alias("_docs")).join(F.broadcast(words)).select("_docs", (F.col("_words") / F.nullif("_docs", F.lit(0))).alias("_avg"))
    asked = queries.select(F.col(query)).distinct().select(query, F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    rows = asked.join(often, "term").join(postings, "term").join(F.broadcast(totals))
    idf = F.log(1 + (F.col("_docs") - F.col("_df") + 0.5) / (F.col("_df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / F.col("_avg")))
    scored = rows.groupBy(query, key).agg(F.round(F.sum(part), 6).alias("score"))
    by = Window.partitionBy(query).orderBy(F.desc("score"), key)
    return scored.withColumn("_rank", F.row_number().over(by)).where(F.col("_rank") <= limit).drop("_rank")


def _count(words: str, term: str) -> Column:
    return F.size(F.filter(words, lambda x: x == F.lit(term)))


def _query_terms(query: str) -> list[str]:
    import re

    return re.findall(r"\w+", query.lower())


def knn(rows: DataFrame, vector: list[float], key: str, column: str = "embedding", limit: int = 20, threshold: float | None = None) -> DataFrame:
    """Nearest rows by cosine to one vector; a top-k, so nothing is sorted as a whole."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    out = rows.select(key, F.round(cosine(F.col(column), q), 6).alias("score"))
    out = out if threshold is None else out.where(F.col("score") >= threshold)
    return out.orderBy(F.desc("score"), key).limit(limit)


def knn_join(queries: DataFrame, rows: DataFrame, key: str, query_key: str, limit: int, column: str = "embedding", max_queries: int = 10_000) -> DataFrame:
    """Nearest rows of each query vector; more than ``max_queries`` of them go to all rows in blocks.

    Vectors of the usual dimension are compared shelf by shelf; those that are
    null, hold a null or have another dimension are compared one by one.
    """
    dim = rows.agg(F.mode(F.size(column), True)).first()[0] or 1
    usual = F.coalesce((F.size(column) == dim) & ~F.exists(column, lambda x: x.isNull()), F.lit(False))
    asked, odd = queries.select(F.col(query_key), F.col(column)), rows.where(~usual).select(key, column)
    by = Window.partitionBy(query_key).orderBy(F.desc("score"), key)

    def top(scored: DataFrame) -> DataFrame:
        return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= limit)

    found = vx.nearest(asked.where(usual), rows.where(usual), query_key, key, limit, column=column)
    for block, others in ((asked.where(usual), odd), (asked.where(~usual), rows.select(key, column))):
        found = found.unionAll(_one_by_one(block.withColumnRenamed(column, "_q"), others, key, query_key, top, column, max_queries))
    return top(found)


def _one_by_one(asked: DataFrame, rows: DataFrame, key: str, query_key: str, top: Callable[[DataFrame], DataFrame], column: str, max_queries: int) -> DataFrame:
    """The ``top`` rows of each query vector ``_q``, of any dimensions."""

    def nearest(block: DataFrame) -> DataFrame:
        return top(rows.join(F.broadcast(block)).select(query_key, key, F.round(cosine(column, "_q"), 6).alias("score"))).drop("rank")

    if rows.isEmpty():
        return nearest(asked.limit(0))
    if asked.limit(max_queries + 1).count() <= max_queries:
        return nearest(asked)
    dealt = materialize(asked.withColumn("_n", F.monotonically_increasing_id()), "knn-queries")
    blocks, largest = 1, dealt.count()
    while largest > max_queries:
        blocks = max(2 * blocks, -(-largest // max_queries))
        block = F.pmod(F.xxhash64("_n"), F.lit(blocks))
        largest = dealt.groupBy(block.alias("_b")).count().agg(F.max("count")).first()[0]
    every = None
    for i in range(blocks):
        part = materialize(nearest(dealt.where(block == i).drop("_n")), "knn-block")
        every = part if every is None else every.unionAll(part)
    return every


def by_similarity(rows: DataFrame, query: str, threshold: float, limit: int, method: str = "jaccard", mode: str = "name_only", snippet: int = 50) -> DataFrame:
    """Families whose newest text resembles the query: ``text`` (matching blocks), ``jaccard`` or ``bleu``."""
    body = F.substring("content", 1, snippet)
    text = {"name_only": F.col("name"), "content_only": body, "name_and_content": F.concat_ws(" ", "name", body)}[mode]
    q = F.lit(query)
    score = {"jaccard": lambda: jaccard(q, text), "bleu": lambda: bleu(q, text), "text": lambda: sequence_ratio(q, text)}[method]()
    scored = rows.withColumn("score", F.round(score, 6)).where(F.col("score") >= threshold)
    best = scored.groupBy("family_id").agg(F.max("score").alias("score"))
    return best.orderBy(F.desc("score"), "family_id").limit(limit)


def occurrences(rows: DataFrame, query: str, key: str = "id", column: str = "content", limit: int = 20) -> DataFrame:
    """Rows that hold the query, by how often (case-folded), newest events first among equals; an empty query finds none."""
    if not query:
        return rows.where("false").select(key, "event_time", F.lit(0).cast("long").alias("score"))
    low, q = F.lower(column), query.lower()
    n = ((F.length(low) - F.length(F.replace(low, F.lit(q), F.lit("")))) / len(q)).cast("long")
    return rows.where(low.contains(q)).select(key, "event_time", n.alias("score")).orderBy(F.desc("score"), F.desc("event_time"), key).limit(limit)


def all_keywords(rows: DataFrame, words: list[str], column: str = "content") -> DataFrame:
    out = rows
    for w in words:
        out = out.where(F.lower(column).contains(w.lower()))
    return out


def ranked(rows: DataFrame, key: str = "family_id") -> DataFrame:
    """Adds the zero-based place of each row by score.

    Rows are dealt by ranges of the score; a place is the number of rows in the
    ranges before plus the place in its own, so no task holds the whole list.
    """
    dealt = materialize(rows.repartitionByRange(F.desc("score"), key).withColumn("_part", F.spark_partition_id()), "ranked")
    sizes = dealt.groupBy("_part").count()
    before = F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("_part", before.alias("_before"))  # one row for each range
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.desc("score"), key))
    return dealt.withColumn("_own", own).join(F.broadcast(shift), "_part").withColumn("rank", F.col("_before") + F.col("_own") - 1).drop("_part", "_own", "_before")


def fuse(arms: list[tuple[DataFrame, float]], key: str = "family_id", k: int = RRF_K, normalise: bool = True) -> DataFrame:
    """Reciprocal-rank fusion of result lists (``key``, ``rank``): sums weight / (k + rank + 1), largest sum becomes one."""
    every = None
    for rows, weight in arms:
        part = rows.select(key, (F.lit(weight) / (F.lit(k) + F.col("rank") + 1)).alias("_part"))
        every = part if every is None else every.unionAll(part)
    total = every.groupBy(key).agg(F.sum("_part").alias("score"))
    if not normalise:
        return total.withColumn("score", F.round("score", 6))
    top = total.agg(F.max("score").alias("_top"))
    return total.join(F.broadcast(top)).select(key, F.round(F.col("score") / F.col("_top"), 4).alias("score"))


def degree_rerank(rows: DataFrame, degrees: DataFrame, key: str = "family_id", alpha: float = 0.3) -> DataFrame:
    """Blends scores with the share of the largest degree."""
    joined = rows.join(degrees.select(F.col("family").alias(key), "degree"), key, "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    top = joined.agg(F.greatest(F.max("degree"), F.lit(1)).alias("_top"))
    blended = F.col("score") * (1 - alpha) + alpha * F.col("degree") / F.col("_top")
    return joined.join(F.broadcast(top)).withColumn("score", F.round(blended, 6)).drop("_top", "degree")


def confidence_rerank(rows: DataFrame, now: str, alpha: float = 0.2, half_life_days: float = 0.0) -> DataFrame:
    """Scales scores by confidence (0.5 where null or zero) and, with a half-life, by age at ``now``."""
    conf = F.coalesce(F.nullif("confidence", F.lit(0.0)), F.lit(0.5))
    score = F.col("score") * (1 - alpha + alpha * conf)
    if half_life_days > 0:
        days = F.greatest((F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("event_time")) / 86_400_000_000, F.lit(0.0))
        score = score * F.exp(-math.log(2) * days / half_life_days)
    return rows.withColumn("score", F.round(score, 6))


def hybrid(entities: DataFrame, query: str, vector_hits: DataFrame | None, graph_hits: DataFrame | None = None, top_k: int = 20) -> DataFrame:
    """Entity search in up to three arms, fused by rank."""
    arms = [(ranked(bm25(entities, "family_id", "content", query, 2 * top_k)), BM25_WEIGHT)]
    if vector_hits is not None:
        arms.append((ranked(vector_hits), VECTOR_WEIGHT))
    if graph_hits is not None:
        arms.append((ranked(graph_hits), GRAPH_WEIGHT))
    return fuse(arms).orderBy(F.desc("score"), "family_id").limit(top_k)


def unified_find(entities: DataFrame, edges: DataFrame, query: str, now: str, vector_hits: DataFrame | None = None, top_k: int = 20, half_life_days: float = 90.0, since: str | None = None, until: str | None = None) -> DataFrame:
    """Recall, endpoint completion, one hop of expansion, time filter, rerank and core-name boost, as one plan.

    ``entities`` are newest rows, ``edges`` newest relations with ``fam1``, ``fam2``.
    """
    hits = hybrid(entities, query, vector_hits, None, top_k).withColumn("source", F.lit("recall"))
    ends = edges.select(F.explode(F.array(F.struct(F.col("fam1").alias("a"), F.col("fam2").alias("b")), F.struct(F.col("fam2").alias("a"), F.col("fam1").alias("b")))).alias("e")).select("e.*").distinct()
    near = hits.join(ends, hits["family_id"] == ends["a"]).groupBy(F.col("b").alias("family_id")).agg((F.max("score") * 0.3).alias("score"))
    more = near.join(hits.select("family_id"), "family_id", "left_anti").withColumn("source", F.lit("expansion"))
    every = hits.select("family_id", "score", "source").unionByName(more.select("family_id", "score", "source")).join(entities, "family_id")
    if since:
        every = every.where(F.col("event_time").isNull() | (F.col("event_time") >= F.lit(since).cast("timestamp")))
    if until:
        every = every.where(F.col("event_time").isNull() | (F.col("event_time") <= F.lit(until).cast("timestamp")))
    scored = confidence_rerank(every, now, half_life_days=half_life_days)
    boosted = F.when(F.lower(core_name("name")) == query.lower(), F.greatest("score", F.lit(1.0))).otherwise(F.col("score"))
    return scored.withColumn("score", F.round(boosted, 6)).orderBy(F.desc("score"), "family_id").limit(top_k)


def name_chain(entities: DataFrame, name: str, limit: int = 5) -> DataFrame:
    """First kind of match that exists: exact name, core name, prefix, BM25."""
    low = name.lower()
    kind = F.when(F.col("name") == name, 0).when(F.lower(core_name("name")) == low, 1).when(F.lower("name").startswith(low), 2)
    direct = entities.withColumn("kind", kind).where("kind is not null").select("family_id", "kind", F.lit(1.0).alias("score"))
    loose = bm25(entities, "family_id", "name", name, limit).select("family_id", F.lit(3).alias("kind"), "score")
    every = direct.unionByName(loose)
    first = every.agg(F.min("kind").alias("_k"))
    return every.join(F.broadcast(first)).where("kind = _k").drop("_k").orderBy(F.desc("score"), "family_id").limit(limit)
