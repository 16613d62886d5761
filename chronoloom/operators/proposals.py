"""Proposed relations saved beside existing ones, seeds by strategy, newest versions by whatever id is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import dream as dr
from chronoloom.operators import relations as rel
from chronoloom.operators.graph import resolve
from chronoloom.operators.temporal import latest

#: Fixed value: what stands before each text that a proposal adds to a relation.
UPDATE = "\n[Dream update] "
ADDED = "additional_dream_cycles"


def by_asked_ids(rows: DataFrame, asked: DataFrame, closed: DataFrame) -> DataFrame:
    """Newest version for each asked id (column ``asked``), found through closed redirects; unknown ids give no row.

    An id that is redirected and has versions of its own still gives its target's.
    """
    wanted = resolve(asked.select("asked", F.col("asked").alias("family_id")).distinct(), closed)
    return wanted.join(latest(rows.join(wanted.select("family_id").distinct(), "family_id", "left_semi")), "family_id")


def seeds(strategy: str, entities: DataFrame, edges: DataFrame, count: int, *, exclude: DataFrame | None = None, members: DataFrame | None = None, now: str | None = None, seed: int = 0) -> DataFrame:
    """``family_id`` and ``reason`` by one of six strategies, without ``exclude`` and, if given, among ``members`` (both: ``family_id``).

    The sets cut candidates before the limit, so ``count`` seeds come back where there are as many;
    a hub's degree still counts its relations to excluded families.
    ``edges`` are relations with the families of their ends (``fam1``, ``fam2``).
    """

    def allowed(rows: DataFrame, column: str = "family_id") -> DataFrame:
        for side, how in ((exclude, "left_anti"), (members, "left_semi")):
            if side is not None:
                rows = rows.join(side.select(F.col("family_id").alias(column)).distinct(), column, how)
        return rows

    if strategy == "random":
        found = dr.seeds_random(allowed(entities), count, seed)
    elif strategy == "orphan":
        found = dr.seeds_orphan(allowed(entities), edges, count)
    elif strategy == "hub":
        degree = allowed(rel.distinct_degrees(edges.where("invalid_at is null")), "family")
        found = degree.orderBy(F.desc("degree"), "family").limit(count).select(F.col("family").alias("family_id"), F.lit("hub").alias("reason"))
    elif strategy == "time_gap":
        if now is None:
            raise ValueError("time_gap needs a time")
        found = dr.seeds_time_gap(allowed(entities), now, count)
    elif strategy == "low_confidence":
        found = dr.seeds_low_confidence(allowed(entities), count)
    elif strategy == "cross_community":
        found = dr.seeds_cross_community(allowed(allowed(edges, "fam1"), "fam2"), count, seed)
    else:
        raise ValueError(f"no strategy {strategy!r}")
    return found.select("family_id", "reason")


def save(pairs: DataFrame, entities: DataFrame, edges: DataFrame, closed: DataFrame, cycle_id: str, now: str) -> DataFrame:
    """Versions to append for proposed pairs (families ``entity1_id``, ``entity2_id``, with ``content``, ``confidence``), each with its ``action``.

    Ends are resolved through redirects.  A pair with a valid relation (hidden
    candidates count too) is ``merged`` into its newest one: new texts follow the
    old, confidence only rises, the cycle is noted.  Any other pair is
    ``created`` as a candidate of a confidence of at most 0.5.  Proposals of one
    pair fold into one version, texts once each, the most confident first.
    Pairs with an unknown end are ``unknown`` and have no version; null
    confidences count as zero, null texts as empty.
    """
    t = F.lit(now).cast("timestamp")
    ends = resolve(resolve(pairs, closed, "entity1_id"), closed, "entity2_id")
    folded = (
        ends.select(F.least("entity1_id", "entity2_id").alias("fam1"), F.greatest("entity1_id", "entity2_id").alias("fam2"), F.coalesce("content", F.lit("")).alias("content"), F.coalesce("confidence", F.lit(0.0)).alias("c"))
        .groupBy("fam1", "fam2", "content").agg(F.max("c").alias("c"))
        .groupBy("fam1", "fam2").agg(F.max("c").alias("c"), F.array_sort(F.collect_list(F.struct((-F.col("c")).alias("k"), "content"))).alias("texts"))
    )
    versions = latest(entities)
    for n in ("1", "2"):
        folded = folded.join(versions.select(F.col("family_id").alias(f"fam{n}"), F.col("id").alias(f"id{n}"), F.col("name").alias(f"name{n}")), f"fam{n}", "left")
    pair = Window.partitionBy("fam1", "fam2").orderBy(F.desc("processed_time"), F.desc("id"))
    old = edges.where("invalid_at is null").join(folded.select("fam1", "fam2"), ["fam1", "fam2"], "left_semi")
    old = old.withColumn("_rank", F.row_number().over(pair)).where("_rank = 1")
    old = old.select("fam1", "fam2", F.struct("family_id", "entity1_id", "entity2_id", F.coalesce("content", F.lit("")).alias("content"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"), "attributes").alias("old"))
    rows = folded.join(old, ["fam1", "fam2"], "left")
    known, merged = F.col("id1").isNotNull() & F.col("id2").isNotNull(), F.col("old").isNotNull()
    texts = F.filter(F.col("texts.content"), lambda x: ~F.coalesce(x == F.col("old.content"), F.lit(False)))
    content = F.array_join(F.when(merged, F.concat(F.array("old.content"), texts)).otherwise(texts), UPDATE)
    key = F.concat_ws("|", "fam1", "fam2")
    cycles = F.concat_ws(",", F.get_json_object("old.attributes", f"$.{ADDED}"), F.lit(cycle_id))
    fresh = F.to_json(F.struct(F.lit("candidate").alias("tier"), F.lit("hypothesized").alias("status"), F.lit("0").alias("corroboration_count"), F.lit(cycle_id).alias("dream_cycle_id")))
    first = F.col("name1") <= F.col("name2")
    saved = lambda c: F.when(known, c)
    family = F.when(merged, F.col("old.family_id")).otherwise(F.concat(F.lit("rel_"), F.substring(F.md5(key), 1, 12)))
    return rows.select(
        "fam1", "fam2", F.when(~known, "unknown").when(merged, "merged").otherwise("created").alias("action"),
        saved(F.concat(F.lit("rel_"), F.substring(F.md5(F.concat_ws("|", key, F.lit(now))), 1, 12))).alias("id"), saved(family).alias("family_id"),
        saved(F.when(merged, F.col("old.entity1_id")).when(first, F.col("id1")).otherwise(F.col("id2"))).alias("entity1_id"),
        saved(F.when(merged, F.col("old.entity2_id")).when(first, F.col("id2")).otherwise(F.col("id1"))).alias("entity2_id"),
        saved(content).alias("content"), saved(t).alias("event_time"), saved(t).alias("processed_time"), saved(F.lit(f"dream:{cycle_id}")).alias("source_document"),
        saved(F.when(merged, F.greatest("old.confidence", "c")).otherwise(F.least("c", F.lit(dr.CANDIDATE_CONFIDENCE)))).alias("confidence"),
        saved(F.when(merged, dr._put(F.col("old.attributes"), **{ADDED: cycles})).otherwise(fresh)).alias("attributes"), saved(t).alias("valid_at"),
    )
