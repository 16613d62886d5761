"""Versions: latest rows, two kinds of as-of views, change feeds, nearest versions, derived validity.

A table of versions has ``id``, ``family_id``, ``event_time``, ``processed_time``
and may have ``valid_at`` and ``invalid_at``.  The newest version is the one of
the largest (processed_time, id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _newest(*keys: str):
    return Window.partitionBy(*keys).orderBy(F.desc("processed_time"), F.desc("id"))


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """One row for each family; Spark limits groups before the shuffle, so long histories stay where they are."""
    return rows.withColumn("_rank", F.row_number().over(_newest(*(keys or ("family_id",))))).where("_rank = 1").drop("_rank")


def at_time(t: Column | str) -> Column:
    return F.lit(t).cast("timestamp") if isinstance(t, str) else t


def is_valid(t: Column | str) -> Column:
    """Validity predicate: the interval [valid_at, invalid_at) holds t, open ends hold all times."""
    t = at_time(t)
    return (F.col("valid_at").isNull() | (F.col("valid_at") <= t)) & (F.col("invalid_at").isNull() | (F.col("invalid_at") > t))


def as_of_event(rows: DataFrame, t: Column | str) -> DataFrame:
    """Newest version of each family among events up to t."""
    return latest(rows.where(F.col("event_time") <= at_time(t)))


def as_of_valid(rows: DataFrame, t: Column | str) -> DataFrame:
    """Newest version of each family among versions valid at t."""
    return latest(rows.where(is_valid(t)))


def with_validity(rows: DataFrame) -> DataFrame:
    """Derives ``valid_at`` and ``invalid_at``: a version ends where its family's next begins, or earlier if it was ended by hand."""
    run = Window.partitionBy("family_id").orderBy("processed_time", "id")
    start = F.coalesce("valid_at", "event_time") if "valid_at" in rows.columns else F.col("event_time")
    following = F.lead("event_time").over(run)
    end = F.least(F.col("invalid_at"), following) if "invalid_at" in rows.columns else following
    return rows.withColumn("_end", end).withColumn("valid_at", start).withColumn("invalid_at", F.col("_end")).drop("_end")


def versions(rows: DataFrame, family_id: str) -> DataFrame:
    return rows.where(F.col("family_id") == family_id).orderBy(F.desc("processed_time"), F.desc("id"))


def version_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("family_id").agg(F.count("*").alias("version_count"))


def versions_up_to(rows: DataFrame, version_id: str) -> DataFrame:
    """The family's versions up to and including one version, in order."""
    last = rows.where(F.col("id") == version_id).select("family_id", F.struct("processed_time", "id").alias("_last"))
    return rows.join(F.broadcast(last), "family_id").where(F.struct("processed_time", "id") <= F.col("_last")).drop("_last")


def snapshot(rows: DataFrame, t: Column | str, limit: int | None = None) -> DataFrame:
    """All versions valid at t, newest events first."""
    out = rows.where(is_valid(t)).orderBy(F.desc("event_time"), F.desc("id"))
    return out.limit(limit) if limit else out


def changes(rows: DataFrame, since: Column | str, until: Column | str) -> DataFrame:
    """Versions whose events lie in [since, until]."""
    return rows.where(F.col("event_time").between(at_time(since), at_time(until)))


def nearest(rows: DataFrame, t: Column | str) -> DataFrame:
    """For each family the version whose event is closest to t; earlier ones win ties, then newer processing."""
    delta = F.abs(F.unix_micros("event_time") - F.unix_micros(at_time(t)))
    by = Window.partitionBy("family_id").orderBy("_delta", F.col("event_time") > at_time(t), F.desc("processed_time"), F.desc("id"))
    out = rows.withColumn("_delta", delta).withColumn("_rank", F.row_number().over(by)).where("_rank = 1")
    return out.withColumn("delta_seconds", F.col("_delta") / 1e6).drop("_rank", "_delta")


def around(rows: DataFrame, t: Column | str, seconds: float) -> DataFrame:
    """Versions within some seconds of t, with their side."""
    t = at_time(t)
    side = F.when(F.col("event_time") < t, "before").when(F.col("event_time") > t, "after").otherwise("exact")
    span = F.make_interval(secs=F.lit(seconds))
    return rows.where(F.col("event_time").between(t - span, t + span)).withColumn("relative_position", side)


def as_of_join(points: DataFrame, rows: DataFrame, key: str = "family_id", at: str = "at") -> DataFrame:
    """For each point the newest version with an event at or before it.

    Points and versions are merged in time order and the last version is carried
    forward: one shuffle on the key, no range join.
    """
    cols = [c for c in rows.columns if c != key]
    right = rows.select(key, F.col("event_time").alias("_t"), F.lit(0).alias("_side"), F.struct(*cols).alias("_row"), F.lit(None).cast("string").alias("_point"))
    names = [c for c in points.columns if c != key]
    left = points.select(key, F.col(at).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.schema["_row"].dataType).alias("_row"), F.struct(*names).alias("_point"))
    both = right.withColumn("_point", F.lit(None).cast(left.schema["_point"].dataType)).unionByName(left)
    run = Window.partitionBy(key).orderBy("_t", "_side", F.col("_row.processed_time"), F.col("_row.id")).rowsBetween(Window.unboundedPreceding, 0)
    filled = both.withColumn("_row", F.last("_row", ignorenulls=True).over(run)).where("_side = 1")
    return filled.select(key, "_point.*", *[F.col(f"_row.{c}").alias(c) for c in cols if c not in names])
