"""Edges between entity versions, read as undirected pairs of families."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.temporal import at_time, latest


def hidden_candidate() -> Column:
    """A dream candidate that no one has verified."""
    get = lambda k: F.get_json_object("attributes", f"$.{k}")
    return F.coalesce((get("tier") == "candidate") & (F.coalesce(get("status"), F.lit("")) != "verified"), F.lit(False))


def visible(rows: DataFrame, include_candidates: bool = False) -> DataFrame:
    return rows if include_candidates else rows.where(~hidden_candidate())


def endpoints(relations: DataFrame) -> DataFrame:
    """One row for each end of a relation: turns "either end matches" into an equi-join."""
    return relations.select("*", F.explode(F.array_distinct(F.array("entity1_id", "entity2_id"))).alias("entity_id"))


def family_edges(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with the families of both ends, as the pair (fam1 <= fam2)."""
    names = entities.select(F.col("id").alias("_id"), F.col("family_id").alias("_fam")).distinct()
    a, b = (names.select(F.col("_id").alias(f"entity{k}_id"), F.col("_fam").alias(f"_f{k}")) for k in (1, 2))
    out = relations.join(a, "entity1_id").join(b, "entity2_id")
    return out.withColumn("fam1", F.least("_f1", "_f2")).withColumn("fam2", F.greatest("_f1", "_f2")).drop("_f1", "_f2")


def between(edges: DataFrame, left: str, right: str, include_candidates: bool = False) -> DataFrame:
    """Newest relations between two families, in either direction."""
    a, b = sorted((left, right))
    return visible(latest(edges.where((F.col("fam1") == a) & (F.col("fam2") == b))), include_candidates)


def between_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Newest valid relations of each distinct undirected pair (``left``, ``right``)."""
    wanted = pairs.select(F.least("left", "right").alias("fam1"), F.greatest("left", "right").alias("fam2")).distinct()
    return latest(edges.where("invalid_at is null").join(wanted, ["fam1", "fam2"]), "fam1", "fam2", "family_id")


def of_entities(relations: DataFrame, ids: DataFrame, t: Column | str | None = None, include_candidates: bool = False) -> DataFrame:
    """Newest relation of each family at each of the entity versions ``entity_id``, optionally as of t."""
    rows = relations if t is None else relations.where(F.col("event_time") <= at_time(t))
    return visible(latest(endpoints(rows).join(ids.distinct(), "entity_id"), "entity_id", "family_id"), include_candidates)


def of_families(edges: DataFrame, families: DataFrame, t: Column | str | None = None, include_candidates: bool = False) -> DataFrame:
    """Newest relation of each relation family at any version of the families ``family``."""
    rows = edges if t is None else edges.where(F.col("event_time") <= at_time(t))
    ends = rows.withColumn("family", F.explode(F.array_distinct(F.array("fam1", "fam2"))))
    return visible(latest(ends.join(families.distinct(), "family"), "family", "family_id"), include_candidates)


def of_latest_version(relations: DataFrame, entities: DataFrame, families: DataFrame, valid_only: bool = False) -> DataFrame:
    """Newest relations that touch the newest version of the families ``family``."""
    now = latest(entities).join(families.distinct().withColumnRenamed("family", "family_id"), "family_id", "left_semi").select(F.col("id").alias("entity_id"), F.col("family_id").alias("family"))
    rows = relations.where("invalid_at is null") if valid_only else relations
    return latest(endpoints(rows).join(now, "entity_id"), "family", "family_id")


def timeline(relations: DataFrame, entity_versions: DataFrame, include_candidates: bool = False) -> DataFrame:
    """Newest relations that were known at the time of the last of the given versions (``entity_id``, ``processed_time``)."""
    last = entity_versions.agg(F.max("processed_time").alias("_last"))
    near = endpoints(relations).join(entity_versions.select("entity_id").distinct(), "entity_id").drop("entity_id").dropDuplicates(["id"])
    return visible(latest(near.join(F.broadcast(last)).where("processed_time <= _last").drop("_last")), include_candidates)


def referencing(relations: DataFrame, ids: DataFrame) -> DataFrame:
    """Relations of each entity version, as a sorted list of ids."""
    return endpoints(relations).join(ids.distinct(), "entity_id").groupBy("entity_id").agg(F.array_sort(F.collect_set("id")).alias("relation_ids"))


def degrees(edges: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """Relation versions at each family; listed families without one have zero."""
    ends = edges.select(F.explode(F.array_distinct(F.array("fam1", "fam2"))).alias("family"))
    counted = ends.groupBy("family").agg(F.count("*").alias("degree"))
    if families is None:
        return counted
    return families.select("family").distinct().join(counted, "family", "left").select("family", F.coalesce("degree", F.lit(0)).alias("degree"))


def distinct_degrees(edges: DataFrame) -> DataFrame:
    """Distinct relation families at each entity family."""
    ends = edges.select(F.explode(F.array_distinct(F.array("fam1", "fam2"))).alias("family"), "family_id")
    return ends.groupBy("family").agg(F.countDistinct("family_id").alias("degree"))


def isolated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Newest valid version of families that no valid relation touches."""
    open_ = entities.where("invalid_at is null")
    touched = endpoints(relations.where("invalid_at is null")).select(F.col("entity_id").alias("id")).distinct()
    linked = open_.join(touched, "id", "left_semi").select("family_id").distinct()
    return latest(open_.join(linked, "family_id", "left_anti"))


def dangling(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Ends that name no entity version."""
    return endpoints(relations).join(entities.select(F.col("id").alias("entity_id")), "entity_id", "left_anti").select(F.col("id").alias("relation_id"), "entity_id")


def profiles(entities: DataFrame, edges: DataFrame, families: DataFrame, include_candidates: bool = False) -> DataFrame:
    """Newest entity, version count and newest relations of each family."""
    wanted = families.select(F.col("family").alias("family_id")).distinct()
    own = entities.join(wanted, "family_id", "left_semi")
    counts = own.groupBy("family_id").agg(F.count("*").alias("version_count"))
    near = of_families(edges.where("invalid_at is null"), families, include_candidates=include_candidates)
    lists = near.groupBy(F.col("family").alias("family_id")).agg(F.array_sort(F.collect_list("id")).alias("relation_ids"))
    return latest(own).join(counts, "family_id").join(lists, "family_id", "left").withColumn("relation_ids", F.coalesce("relation_ids", F.array().cast("array<string>")))


def scope_tags(edges: DataFrame, entities: DataFrame, family: str, version_id: str) -> DataFrame:
    """Relations of a family with their place in its history: at the version, inherited from earlier ones, or future."""
    own = entities.where(F.col("family_id") == family)
    target = own.where(F.col("id") == version_id).select(F.struct("processed_time", "id").alias("_at"))
    ranked = own.join(F.broadcast(target)).select(
        F.col("id").alias("entity_id"),
        F.when(F.struct("processed_time", "id") == F.col("_at"), 0).when(F.struct("processed_time", "id") < F.col("_at"), 1).otherwise(2).alias("_place"),
    )
    near = endpoints(edges).join(ranked, "entity_id")
    tag = F.element_at(F.array(F.lit("current"), F.lit("inherited"), F.lit("future")), F.min("_place") + 1)
    return near.groupBy("family_id").agg(tag.alias("scope"), F.max_by("id", F.struct("processed_time", "id")).alias("id"))


def with_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Adds the names of both ends."""
    names = entities.select(F.col("id").alias("_id"), F.col("name").alias("_name"))
    for k in (1, 2):
        relations = relations.join(names.select(F.col("_id").alias(f"entity{k}_id"), F.col("_name").alias(f"entity{k}_name")), f"entity{k}_id", "left")
    return relations


