"""Writes as new rows or derived tables: versions are appended, nothing is changed in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import section_hash
from chronoloom.operators.graph import redirect_closure, resolve

CORROBORATION, DREAM_CORROBORATION, CONTRADICTION = 0.05, 0.025, 0.1


def append_versions(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The log with new versions; the first row of an id counts, validity is derived by ``temporal.with_validity``."""
    fresh = new.dropDuplicates(["id"]).join(rows.select("id"), "id", "left_anti")
    return rows.unionByName(fresh, allowMissingColumns=True)


def fold_overrides(rows: DataFrame, overrides: DataFrame, fields: list[str]) -> DataFrame:
    """Applies field updates (``id``, ``field``, ``value``, ``seq``); the last one of a field counts."""
    last = overrides.groupBy("id").agg(*[F.max_by(F.when(F.col("field") == f, F.col("value")), F.when(F.col("field") == f, F.col("seq"))).alias(f"_{f}") for f in fields])
    out = rows.join(last, "id", "left")
    for f in fields:
        out = out.withColumn(f, F.coalesce(F.col(f"_{f}").cast(rows.schema[f].dataType), F.col(f))).drop(f"_{f}")
    return out


def update_newest(rows: DataFrame, changes: DataFrame, field: str) -> DataFrame:
    """Sets a field of the newest version of the families in ``changes`` (``family_id``, ``value``)."""
    newest = F.row_number().over(Window.partitionBy("family_id").orderBy(F.desc("processed_time"), F.desc("id"))) == 1
    out = rows.withColumn("_newest", newest).join(changes.select("family_id", F.col("value").alias("_value")), "family_id", "left")
    return out.withColumn(field, F.when(F.col("_newest") & F.col("_value").isNotNull(), F.col("_value")).otherwise(F.col(field))).drop("_newest", "_value")


def clamp(confidence: Column) -> Column:
    return F.greatest(F.least(confidence, F.lit(1.0)), F.lit(0.0))


def adjust_confidence(rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """Folds evidence (``family_id``, ``kind``) into the newest versions: corroboration +0.05, by dream +0.025, contradiction -0.1; null confidence stays."""
    step = F.when(F.col("kind") == "corroboration", CORROBORATION).when(F.col("kind") == "dream", DREAM_CORROBORATION).when(F.col("kind") == "contradiction", -CONTRADICTION).otherwise(0.0)
    total = evidence.groupBy("family_id").agg(F.sum(step).alias("_step"))
    newest = F.row_number().over(Window.partitionBy("family_id").orderBy(F.desc("processed_time"), F.desc("id"))) == 1
    out = rows.withColumn("_newest", newest).join(total, "family_id", "left")
    value = F.when(F.col("_newest") & F.col("_step").isNotNull(), F.round(clamp(F.col("confidence") + F.col("_step")), 6)).otherwise(F.col("confidence"))
    return out.withColumn("confidence", value).drop("_newest", "_step")


def invalidate(rows: DataFrame, families: DataFrame, now: str) -> DataFrame:
    """Ends the open versions of some families."""
    hit = families.select("family_id", F.lit(True).alias("_hit")).distinct()
    end = F.when(F.col("_hit") & F.col("invalid_at").isNull(), F.lit(now).cast("timestamp")).otherwise(F.col("invalid_at"))
    return rows.join(hit, "family_id", "left").withColumn("invalid_at", end).drop("_hit")


def merge_families(rows: DataFrame, redirects: DataFrame, target: str, sources: list[str], now: str) -> tuple[DataFrame, DataFrame]:
    """Relabels the sources' versions; returns the rows and the redirects with the new ones."""
    spark = rows.sparkSession
    new = spark.createDataFrame([(s, target) for s in sources if s != target], "source_family_id string, target_family_id string").withColumn("updated_at", F.lit(now).cast("timestamp"))
    every = redirects.unionByName(new)
    return resolve(rows, redirect_closure(every)), every


def split_version(rows: DataFrame, version_id: str, new_family: str) -> DataFrame:
    return rows.withColumn("family_id", F.when(F.col("id") == version_id, F.lit(new_family)).otherwise(F.col("family_id")))


def redirect_ends(relations: DataFrame, entities: DataFrame, old_family: str, new_family: str) -> DataFrame:
    """Points every end at a family to another family's newest version."""
    old = entities.where(F.col("family_id") == old_family).select(F.col("id").alias("_old"))
    to = entities.where(F.col("family_id") == new_family).agg(F.max_by("id", F.struct("processed_time", "id")).alias("_to"))
    moves = old.join(F.broadcast(to))
    out = relations
    for side in ("entity1_id", "entity2_id"):
        out = out.join(moves, out[side] == F.col("_old"), "left").withColumn(side, F.coalesce("_to", side)).drop("_old", "_to")
    return out


def delete(rows: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    return rows.join(keys.select(on).distinct(), on, "left_anti")


def purge_invalid(rows: DataFrame, before: str | None = None) -> DataFrame:
    """Rows without versions that ended (before some time)."""
    ended = F.col("invalid_at").isNotNull()
    if before:
        ended = ended & (F.col("invalid_at") < F.lit(before).cast("timestamp"))
    return rows.where(~ended)


def upsert_mentions(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row for each (episode, target, type); new rows replace old ones."""
    both = old.withColumn("_age", F.lit(0)).unionByName(new.withColumn("_age", F.lit(1)))
    return both.groupBy("episode_id", "target_id", "target_type").agg(F.max_by("mention_context", F.struct("_age", "mention_context")).alias("mention_context"))


def section_patches(diffs: DataFrame) -> DataFrame:
    """Patch rows of the changed sections (``family_id``, ``id``, ``changes`` from ``section_changes``)."""
    rows = diffs.select("family_id", "id", F.explode("changes").alias("c")).where("c.change_type <> 'unchanged'")
    return rows.select("family_id", "id", "c.section_key", "c.change_type", section_hash("c.old").alias("old_hash"), section_hash("c.new").alias("new_hash"))
