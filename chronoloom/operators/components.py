"""Connected components by alternating star contractions.

Every round replaces each vertex's links by links to its smallest neighbour
(first over larger, then over smaller neighbours), so the links shrink to one
star per component in a logarithmic number of rounds.  A round is two
aggregates with map-side combine and two equi-joins, so a vertex that holds a
third of all links is spread by partial aggregation and by the skew join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.plans.materialize import materialize


def _digest(edges: DataFrame):
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r["n"], r["x"]


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def connected_components(edges: DataFrame, left: str, right: str, max_rounds: int = 60) -> DataFrame:
    """Smallest reachable id of every linked vertex: columns ``id``, ``component``.

    ``edges`` holds undirected links of any orderable type; null endpoints are
    no links, self links yield their own component, repeats are harmless.
    """
    linked = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).where("u is not null and v is not null")
    loops = linked.where("u = v").select("u")
    star = materialize(
        linked.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc"
    )
    before = _digest(star)
    for _ in range(max_rounds if before[0] else 0):
        near = _both(star)
        low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = near.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = materialize(large, "cc")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        star = materialize(
            small.select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionAll(low.select("u", F.col("m").alias("v")))
            .where("u <> v")
            .distinct(),
            "cc",
        )
        after = _digest(star)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = star.select(F.col("v").alias("id"), F.col("v").alias("component"))
    members = star.select(F.col("u").alias("id"), F.col("v").alias("component"))
    own = loops.select(F.col("u").alias("id"), F.col("u").alias("component"))
    return members.unionAll(roots).unionAll(own).groupBy("id").agg(F.min("component").alias("component"))
