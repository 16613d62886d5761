"""Derived tables kept up from a change feed: edges between current versions, and newest versions.

Only what a change can reach is computed again.  Each refresh gives the rows to
delete and to insert, so a table elsewhere can follow, and the number of rows it
looked at can be counted; applied, it equals a full recompute.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.graph import resolve
from chronoloom.operators.temporal import at_time, latest
from chronoloom.plans.materialize import materialize

EDGE = ["relation_id", "family_id", "fam1", "fam2", "source_id", "target_id", "content"]


def known_at(rows: DataFrame, t: Column | str) -> DataFrame:
    """The table as it stood at a time: rows processed by then, ends after it still open."""
    t = at_time(t)
    return rows.where(F.col("processed_time") <= t).withColumn("invalid_at", F.when(F.col("invalid_at") <= t, F.col("invalid_at")))


def feed(rows: DataFrame, since: Column | str, until: Column | str) -> DataFrame:
    """Rows that were written, or whose validity ended, after ``since`` and up to ``until``."""
    a, b = at_time(since), at_time(until)
    within = lambda c: (F.col(c) > a) & (F.col(c) <= b)
    return rows.where(within("processed_time") | F.coalesce(within("invalid_at"), F.lit(False)))


def current_edges(relations: DataFrame, entities: DataFrame, redirects: DataFrame | None = None) -> DataFrame:
    """An edge for each open relation, between the current versions of its ends' families.

    Ends name any version; a family that was merged away stands for its target
    (``redirects`` is a closure: source and final target).  Relations with an
    end that has no open version, and those of a family with itself, have no edge.
    """
    rows = entities.select("id", "family_id", "processed_time", "invalid_at")
    rows = rows if redirects is None else resolve(rows, redirects)
    family = rows.select("id", "family_id")
    current = latest(rows.where("invalid_at is null")).select("family_id", "id")
    out = relations.where("invalid_at is null").select(F.col("id").alias("relation_id"), "family_id", "entity1_id", "entity2_id", "content")
    for k, end in ((1, "source_id"), (2, "target_id")):
        out = out.join(family.select(F.col("id").alias(f"entity{k}_id"), F.col("family_id").alias(f"fam{k}")), f"entity{k}_id")
        out = out.join(current.select(F.col("family_id").alias(f"fam{k}"), F.col("id").alias(end)), f"fam{k}")
    return out.where("fam1 <> fam2").select(*EDGE)


def refresh_edges(old: DataFrame, relations: DataFrame, entities: DataFrame, changed_relations: DataFrame, changed_entities: DataFrame, redirects: DataFrame | None = None, new_redirects: DataFrame | None = None) -> DataFrame:
    """What a batch of changes does to the edges ``old``: rows with ``op`` (``delete`` or ``insert``).

    ``relations`` and ``entities`` are the tables after the batch; the changed
    rows come from ``feed``; ``new_redirects`` are the sources that were
    redirected in the batch.  Touched are the changed relations and those with an
    end in a changed family, before or after its redirect.
    """
    families = changed_entities.select("family_id")
    if redirects is not None and new_redirects is not None:
        moved = redirects.join(new_redirects.select("source_family_id"), "source_family_id", "left_semi")
        families = families.unionAll(moved.select("source_family_id")).unionAll(moved.select("target_family_id"))
        touched_sources = redirects.join(families.select(F.col("family_id").alias("target_family_id")).distinct(), "target_family_id", "left_semi")
        families = families.unionAll(touched_sources.select("source_family_id"))
    families = materialize(families.distinct(), "touched-families")
    ends = entities.join(families, "family_id", "left_semi").select(F.col("id").alias("end"))
    met = relations.select(F.col("id").alias("relation_id"), F.explode(F.array("entity1_id", "entity2_id")).alias("end")).join(ends, "end", "left_semi").select("relation_id")
    touched = materialize(met.unionAll(changed_relations.select(F.col("id").alias("relation_id"))).distinct(), "touched-relations")

    again = relations.join(touched.withColumnRenamed("relation_id", "id"), "id", "left_semi")
    own_ends = again.select(F.explode(F.array("entity1_id", "entity2_id")).alias("id")).distinct()
    near = entities.join(own_ends, "id", "left_semi").select("family_id").distinct()
    if redirects is not None:
        target = resolve(near, redirects).distinct()
        near = near.unionAll(target).unionAll(redirects.select(F.col("target_family_id").alias("family_id"), "source_family_id").join(target, "family_id", "left_semi").select(F.col("source_family_id").alias("family_id"))).distinct()
    new = materialize(current_edges(again, entities.join(near, "family_id", "left_semi"), redirects), "new-edges")
    was = old.join(touched, "relation_id", "left_semi").select(*EDGE)
    same = lambda a, b: a.join(b.select(*[F.col(c).alias(f"_{c}") for c in EDGE]), F.expr(" and ".join(f"{c} <=> _{c}" for c in EDGE)), "left_anti")
    return same(was, new).withColumn("op", F.lit("delete")).unionByName(same(new, was).withColumn("op", F.lit("insert")))


def refresh_newest(old: DataFrame, changed: DataFrame, rows: DataFrame) -> DataFrame:
    """What a batch does to the newest versions ``old`` (rows of one ``family_id`` each): ``family_id``, ``id`` and ``op``.

    ``rows`` is the table after the batch; only the changed families are ranked again.
    """
    families = materialize(changed.select("family_id").distinct(), "touched-families")
    new = latest(rows.join(families, "family_id", "left_semi").where("invalid_at is null")).select("family_id", "id")
    was = old.join(families, "family_id", "left_semi").select("family_id", "id")
    both = was.join(new.select("family_id", F.col("id").alias("now")), "family_id", "full").where("not (id <=> now)")
    ops = F.explode(F.array(F.struct(F.col("id"), F.lit("delete").alias("op")), F.struct(F.col("now").alias("id"), F.lit("insert").alias("op"))))
    return both.select("family_id", ops.alias("o")).select("family_id", "o.id", "o.op").where("id is not null")


def applied(old: DataFrame, delta: DataFrame, key: str) -> DataFrame:
    """The table after a refresh; ``key`` names a row."""
    gone = delta.where("op = 'delete'").select(key)
    return old.join(gone, key, "left_anti").select(*old.columns).unionByName(delta.where("op = 'insert'").select(*old.columns))
