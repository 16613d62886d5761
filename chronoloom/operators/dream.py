"""Consolidation: seeds, candidate relations and their life-cycle as appended versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.operators import relations as rel
from chronoloom.operators.components import connected_components
from chronoloom.operators.temporal import latest

CANDIDATE_CONFIDENCE, PROMOTED, REJECTED, CORROBORATED, STEP, PROMOTE_AT = 0.5, 0.7, 0.2, 0.69, 0.1, 2


def _newest_valid(entities: DataFrame) -> DataFrame:
    return latest(entities.where("invalid_at is null"))


def seeds_random(entities: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """A seeded draw: the smallest hashes of seed and family, which doesn't depend on partitions."""
    spot = F.md5(F.concat_ws("|", F.lit(str(seed)), "family_id"))
    return _newest_valid(entities).orderBy(spot, "family_id").limit(count).withColumn("reason", F.lit("random"))


def seeds_orphan(entities: DataFrame, relations: DataFrame, count: int) -> DataFrame:
    return rel.isolated(entities, relations).orderBy(F.desc("processed_time"), F.desc("id")).limit(count).withColumn("reason", F.lit("orphan"))


def seeds_hub(edges: DataFrame, count: int) -> DataFrame:
    """Families with the most distinct valid relations."""
    degree = rel.distinct_degrees(edges.where("invalid_at is null"))
    return degree.orderBy(F.desc("degree"), "family").limit(count).withColumn("reason", F.lit("hub"))


def seeds_time_gap(entities: DataFrame, now: str, count: int, days: float = 30) -> DataFrame:
    """Families whose newest version is older than some days, oldest first."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros("processed_time")) / 86_400_000_000
    return _newest_valid(entities).where(age > days).orderBy("processed_time", "id").limit(count).withColumn("reason", F.lit("time_gap"))


def seeds_low_confidence(entities: DataFrame, count: int, below: float = 0.5) -> DataFrame:
    return _newest_valid(entities).where(F.col("confidence") < below).orderBy("confidence", "id").limit(count).withColumn("reason", F.lit("low_confidence"))


def seeds_cross_community(edges: DataFrame, count: int, seed: int = 0) -> DataFrame:
    """Pairs of families of different components: a seeded order of each component's members, matched by place."""
    parts = connected_components(edges.where("invalid_at is null"), "fam1", "fam2")
    spot = F.md5(F.concat_ws("|", F.lit(str(seed)), "id"))
    top = Window.partitionBy("component").orderBy("spot", "id")
    members = parts.withColumn("spot", spot).withColumn("place", F.row_number().over(top)).where(F.col("place") <= count)
    sizes = members.groupBy("component").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "component").limit(2 * count)
    numbered = sizes.withColumn("no", F.row_number().over(Window.orderBy(F.desc("n"), "component")) - 1)
    near = members.join(F.broadcast(numbered.select("component", "no")), "component")
    a = near.where("no % 2 = 0").select((F.col("no") / 2).cast("int").alias("pair"), "place", F.col("id").alias("family_id"))
    b = near.where("no % 2 = 1").select((F.col("no") / 2).cast("int").alias("pair"), "place", F.col("id").alias("pair_with"))
    return a.join(b, ["pair", "place"]).orderBy("place", "pair").limit(count).select("family_id", "pair_with", F.lit("cross_community").alias("reason"))


def _put(attributes: Column, **values) -> Column:
    """JSON attributes with some keys set; values become strings."""
    kept = F.coalesce(F.from_json(attributes, "map<string,string>"), F.create_map().cast("map<string,string>"))
    new = F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(str(v)))])
    drop = [F.lit(k) for k in values]
    return F.to_json(F.map_concat(F.map_filter(kept, lambda k, _: ~k.isin(*values)), new)) if drop else attributes


def candidates(relations: DataFrame, status: str | None = None) -> DataFrame:
    """Newest valid relations that a dream proposed, optionally of one status."""
    tier = F.get_json_object("attributes", "$.tier")
    rows = latest(relations.where("invalid_at is null")).where(tier.isin("candidate", "verified", "rejected") & F.col("source_document").startswith("dream"))
    return rows if status is None else rows.where(F.get_json_object("attributes", "$.status") == status)


def propose(pairs: DataFrame, cycle_id: str, now: str) -> DataFrame:
    """New candidates from judged pairs (``entity1_id``, ``entity2_id``, ``content``, ``confidence``, ``reasoning``)."""
    t = F.lit(now).cast("timestamp")
    attributes = F.to_json(F.struct(F.lit("candidate").alias("tier"), F.lit("hypothesized").alias("status"), F.lit("0").alias("corroboration_count"), F.lit(cycle_id).alias("dream_cycle_id"), "reasoning"))
    key = F.concat_ws("|", F.least("entity1_id", "entity2_id"), F.greatest("entity1_id", "entity2_id"))
    return pairs.select(
        F.concat(F.lit("rel_"), F.substring(F.md5(F.concat_ws("|", key, F.lit(now))), 1, 12)).alias("id"),
        F.concat(F.lit("rel_"), F.substring(F.md5(key), 1, 12)).alias("family_id"),
        F.least("entity1_id", "entity2_id").alias("entity1_id"), F.greatest("entity1_id", "entity2_id").alias("entity2_id"),
        "content", t.alias("event_time"), t.alias("processed_time"), F.lit(f"dream:{cycle_id}").alias("source_document"),
        F.least("confidence", F.lit(CANDIDATE_CONFIDENCE)).alias("confidence"), attributes.alias("attributes"), t.alias("valid_at"),
    )


def _version(rows: DataFrame, now: str, confidence: Column, attributes: Column) -> DataFrame:
    t = F.lit(now).cast("timestamp")
    new = rows.withColumn("confidence", confidence).withColumn("attributes", attributes)
    return new.withColumn("id", F.concat("id", F.lit("+"), F.date_format(t, "yyyyMMddHHmmss"))).withColumn("processed_time", t).withColumn("event_time", t).withColumn("valid_at", t)


def promote(rows: DataFrame, now: str, evidence: str = "manual", confidence: float | None = None) -> DataFrame:
    """Next versions of candidates, verified: confidence at least 0.7 or as given, one more corroboration."""
    c = F.lit(confidence) if confidence is not None else F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(PROMOTED))
    n = F.coalesce(F.get_json_object("attributes", "$.corroboration_count").try_cast("int"), F.lit(0)) + 1
    return _version(rows, now, c, _put(F.col("attributes"), tier="verified", status="verified", evidence_source=evidence, corroboration_count=n.cast("string")))


def demote(rows: DataFrame, now: str, reason: str = "") -> DataFrame:
    """Next versions of candidates, rejected: confidence at most 0.2."""
    return _version(rows, now, F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(REJECTED)), _put(F.col("attributes"), status="rejected", rejection_reason=reason))


def reject_cycle(relations: DataFrame, cycle_id: str, now: str) -> DataFrame:
    """Demotes every undecided candidate of a cycle."""
    return demote(candidates(relations, "hypothesized").where(F.get_json_object("attributes", "$.dream_cycle_id") == cycle_id), now, f"cycle {cycle_id} rejected")


def corroborate(pairs: DataFrame, evidence: DataFrame) -> DataFrame:
    """Folds evidence (``fam1``, ``fam2``, one row for each) into candidates: +0.1 each up to 0.69, promoted at two."""
    seen = evidence.groupBy("fam1", "fam2").agg(F.count("*").alias("hits"))
    total = F.coalesce("corroboration_count", F.lit(0)) + F.coalesce("hits", F.lit(0))
    raised = F.when(F.coalesce("hits", F.lit(0)) == 0, F.col("confidence")).otherwise(F.least(F.col("confidence") + STEP * F.col("hits"), F.lit(CORROBORATED)))
    joined = pairs.join(seen, ["fam1", "fam2"], "left").withColumn("corroboration_count", total)
    joined = joined.withColumn("status", F.when((F.col("corroboration_count") >= PROMOTE_AT) & (F.col("status") == "hypothesized"), "verified").otherwise(F.col("status")))
    return joined.withColumn("confidence", F.round(F.when(F.col("status") == "verified", F.greatest(raised, F.lit(PROMOTED))).otherwise(raised), 6)).drop("hits")


def unchecked_pairs(seeds: DataFrame, explored: DataFrame, edges: DataFrame, history: DataFrame) -> DataFrame:
    """Pairs of a seed and a node explored from it, without those checked before or already related."""
    pairs = explored.join(seeds.select(F.col("family_id").alias("seed")), "seed").where("seed <> family_id")
    pairs = pairs.select(F.least("seed", "family_id").alias("fam1"), F.greatest("seed", "family_id").alias("fam2")).distinct()
    return pairs.join(history.select("fam1", "fam2"), ["fam1", "fam2"], "left_anti").join(edges.select("fam1", "fam2").distinct(), ["fam1", "fam2"], "left_anti")


def next_strategy(history: DataFrame, strategies: list[str]) -> DataFrame:
    """Unused strategies first, then the one that found most for its cycles, then the name."""
    every = history.sparkSession.createDataFrame([(i, s) for i, s in enumerate(strategies)], "place int, strategy string")
    used = history.groupBy("strategy").agg(F.count("*").alias("cycles"), F.sum("relations_created").alias("made"))
    joined = every.join(used, "strategy", "left")
    return joined.orderBy(F.col("cycles").isNotNull(), F.desc(F.coalesce(F.col("made") / F.col("cycles"), F.lit(0.0))), "place").limit(1).select("strategy")
