"""Counts, degrees, quality and activity of a graph, each from one or two aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.relations import dangling, endpoints


def family_counts(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Distinct valid families of both tables."""
    one = lambda df, name: df.where("invalid_at is null").agg(F.countDistinct("family_id").alias(name))
    return one(entities, "entities").join(F.broadcast(one(relations, "relations")))


def graph_statistics(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows, families, mean and largest degree over endpoints, isolated versions and density, in one row."""
    ends = relations.select(F.explode(F.array("entity1_id", "entity2_id")).alias("id"))
    degree = ends.groupBy("id").agg(F.count("*").alias("d")).agg(F.round(F.avg("d"), 6).alias("avg_degree"), F.max("d").alias("max_degree"))
    e = entities.agg(F.count("*").alias("entity_versions"), F.countDistinct("family_id").alias("entity_families"))
    r = relations.agg(F.count("*").alias("relation_versions"), F.countDistinct("family_id").alias("relation_families"))
    lone = entities.select("id", "family_id").join(ends.distinct(), "id", "left_anti").agg(F.countDistinct("family_id").alias("isolated_families"))
    out = e.join(F.broadcast(r)).join(F.broadcast(degree)).join(F.broadcast(lone))
    pairs = F.col("entity_families") * (F.col("entity_families") - 1) / 2
    return out.withColumn("density", F.when(F.col("entity_families") > 1, F.round(F.col("relation_families") / pairs, 4)).otherwise(0.0))


def daily_counts(rows: DataFrame, days: int = 30) -> DataFrame:
    """Versions of each day, oldest days first."""
    return rows.groupBy(F.to_date("event_time").alias("day")).agg(F.count("*").alias("n")).orderBy("day").limit(days)


def quality_report(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Valid, invalid, nameless and dangling rows."""
    e = entities.agg(
        F.count_if(F.col("invalid_at").isNull()).alias("valid_entities"), F.count_if(F.col("invalid_at").isNotNull()).alias("invalid_entities"),
        F.count_if(F.trim(F.coalesce("name", F.lit(""))) == "").alias("nameless_entities"),
    )
    r = relations.agg(F.count_if(F.col("invalid_at").isNull()).alias("valid_relations"), F.count_if(F.col("invalid_at").isNotNull()).alias("invalid_relations"))
    d = dangling(relations, entities).agg(F.count("*").alias("dangling_ends"))
    return e.join(F.broadcast(r)).join(F.broadcast(d))


def recommendations(stats: DataFrame) -> DataFrame:
    """Rule-based advice from one row of statistics: rule, priority."""
    rules = [
        ("connect_isolated", F.when(F.col("isolated_families") > 20, "high").when(F.col("isolated_families") > 0, "medium")),
        ("discover_relations", F.when(F.col("relation_families") < 0.3 * F.col("entity_families"), "high")),
        ("clean_versions", F.when(F.col("entity_versions") > 5 * F.col("entity_families"), "medium")),
    ]
    every = F.array(*[F.struct(F.lit(n).alias("rule"), p.alias("priority")) for n, p in rules])
    return stats.select(F.explode(every).alias("r")).select("r.*").where("priority is not null")


def request_metrics(requests: DataFrame, now: str, since_seconds: int = 300) -> DataFrame:
    """Requests of the last seconds: count, error share, mean and largest latency, rate."""
    start = F.lit(now).cast("timestamp") - F.make_interval(secs=F.lit(since_seconds))
    near = requests.where((F.col("ts") >= start) & (F.col("ts") <= F.lit(now).cast("timestamp")))
    return near.agg(
        F.count("*").alias("requests"), F.coalesce(F.round(F.avg((F.col("status") >= 400).cast("double")), 6), F.lit(0.0)).alias("error_rate"),
        F.round(F.avg("latency"), 6).alias("avg_latency"), F.max("latency").alias("max_latency"), F.round(F.count("*") / (since_seconds / 60), 6).alias("per_minute"),
    )


def top_paths(requests: DataFrame, n: int = 10) -> DataFrame:
    return requests.groupBy("path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "path").limit(n)


def key_nodes(relations: DataFrame, n: int = 10) -> DataFrame:
    return endpoints(relations).groupBy("entity_id").agg(F.count("*").alias("degree")).orderBy(F.desc("degree"), "entity_id").limit(n)


def metric_summary(rows: DataFrame, keys: list[str], metric: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.round(F.avg(metric), 6).alias("mean"), F.round(F.stddev_pop(metric), 6).alias("std"), F.count(metric).alias("n"))
