"""Traversal of the concept graph as it was at a time, with a cost for each kind of step."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.operators.concepts import hidden_hypothesis
from chronoloom.operators.temporal import as_of_valid, latest
from chronoloom.plans.materialize import materialize

#: Cost of a step onto a concept of each role.
COSTS = {"entity": 1, "relation": 1, "observation": 1}


def standing(rows: DataFrame, t: Column | str | None = None) -> DataFrame:
    """The version of each family that holds at a time (the newest without one), without open hypotheses: ``family_id``, ``id``, ``role``, ``connects``."""
    now = as_of_valid(rows, t) if t is not None else latest(rows)
    return now.where(~hidden_hypothesis()).select("family_id", "id", "role", "connects")


def steps(rows: DataFrame, mentions: DataFrame, t: Column | str | None = None, costs: dict[str, int] = COSTS) -> tuple[DataFrame, DataFrame]:
    """The standing concepts, and the steps ``u``, ``v``, ``cost`` between their families.

    An entity leads to the relations that hold any of its versions, a relation to
    the families of its ends, an observation to what its standing version
    mentions.  Ends and mentions name versions; a step needs the family's version
    of that time, whichever version was named.
    """
    now = materialize(standing(rows, t), "standing")
    family = rows.where("role <> 'observation'").select("id", F.col("family_id").alias("named")).join(now.select(F.col("family_id").alias("named")), "named", "left_semi")
    ends = now.where("role = 'relation'").select("family_id", F.explode("connects").alias("id")).join(family, "id").select(F.col("family_id").alias("relation"), "named")
    ends = ends.join(now.where("role = 'entity'").select(F.col("family_id").alias("named")), "named", "left_semi").distinct()
    told = now.where("role = 'observation'").select("family_id", F.col("id").alias("episode_id")).join(mentions, "episode_id").select("family_id", F.col("target_id").alias("id"))
    told = told.join(family, "id").select(F.col("family_id").alias("u"), F.col("named").alias("v")).distinct()
    every = ends.select(F.col("relation").alias("u"), F.col("named").alias("v")).unionAll(ends.select(F.col("named").alias("u"), F.col("relation").alias("v"))).unionAll(told)
    cost = F.lit(0)
    for role, c in costs.items():
        cost = F.when(F.col("role") == role, c).otherwise(cost)
    every = every.join(now.select(F.col("family_id").alias("v"), cost.cast("int").alias("cost")), "v").select("u", "v", "cost")
    return now, materialize(every, "steps")


def traverse(graph: tuple[DataFrame, DataFrame], starts: DataFrame, most: int = 2) -> DataFrame:
    """Standing concepts within a cost of the starts (``family_id``): ``family_id``, ``id``, ``role`` and their least ``cost``.

    Each round only takes steps from concepts whose cost fell in the round
    before; starts that don't stand at the time lead nowhere.  Costs are whole
    numbers from zero up, so a cheaper way in a later round replaces a dearer one.
    """
    now, near = graph
    best = materialize(starts.select("family_id").distinct().join(now.select("family_id"), "family_id", "left_semi").withColumn("cost", F.lit(0)), "reached")
    fresh = best
    while not fresh.isEmpty():
        onward = fresh.select(F.col("family_id").alias("u"), F.col("cost").alias("so_far")).join(near, "u")
        onward = onward.select(F.col("v").alias("family_id"), (F.col("so_far") + F.col("cost")).alias("cost")).where(F.col("cost") <= most)
        tried = onward.groupBy("family_id").agg(F.min("cost").alias("cost"))
        fresh = materialize(tried.join(best.select("family_id", F.col("cost").alias("had")), "family_id", "left").where("had is null or cost < had").select("family_id", "cost"), "fresh")
        best = materialize(best.join(fresh.select("family_id"), "family_id", "left_anti").unionByName(fresh), "reached")
    return best.join(now, "family_id").select("family_id", "id", "role", "cost")


def crossed(graph: tuple[DataFrame, DataFrame], reached: DataFrame, most: int = 2) -> DataFrame:
    """Relations that a traversal met: those reached, and those next to a concept reached."""
    now, near = graph
    relations = now.where("role = 'relation'").select("family_id", "id")
    met = near.join(reached.where(F.col("cost") <= most).select(F.col("family_id").alias("u")), "u", "left_semi").select(F.col("v").alias("family_id"))
    return relations.join(met.unionAll(reached.select("family_id")).distinct(), "family_id", "left_semi")
