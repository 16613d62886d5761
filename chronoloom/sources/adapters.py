"""The star-schema tables read as versioned graph tables.

Events are the versions of users, line items the versions of part-supplier
relations, orders the episodes that mention parts and suppliers, nations redirect to regions.
Each view has the same definition in SQL, for checks against another engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoloom.operators.temporal import with_validity

#: The same views in SQL.
SQL = {
    "entities": """SELECT 'e' || event_id AS id, 'u' || user_id AS family_id, event_type AS name, event_type || ' ' || props AS content,
  ts AS event_time, ts AS processed_time, 'doc' || (event_id % 50) AS source_document, round(value / 500, 6) AS confidence, props AS attributes,
  ts AS valid_at, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, 'e' || event_id) AS invalid_at FROM events""",
    "relations": """SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, 'p' || l_partkey || '-s' || l_suppkey AS family_id,
  'p' || l_partkey AS entity1_id, 's' || l_suppkey AS entity2_id, l_returnflag || ' ' || l_linestatus || ' ' || CAST(l_quantity AS BIGINT) AS content,
  l_shipdate AS event_time, l_shipdate AS processed_time, 'o' || l_orderkey AS episode_id,
  CASE WHEN l_returnflag = 'R' THEN 'dream:c' || l_linenumber ELSE 'doc' || (l_orderkey % 50) END AS source_document, round(1 - l_discount, 6) AS confidence,
  CASE WHEN l_returnflag = 'R' THEN '{"tier":"candidate","status":"' || CASE WHEN l_linestatus = 'O' THEN 'hypothesized' ELSE 'verified' END || '","corroboration_count":"' || (l_linenumber % 3) || '","dream_cycle_id":"c' || l_linenumber || '"}' END AS attributes,
  l_shipdate AS valid_at, CASE WHEN l_returnflag = 'N' AND l_linestatus = 'F' AND l_quantity < 10 THEN l_shipdate + INTERVAL 90 DAY END AS invalid_at FROM lineitem""",
    "things": """SELECT 'p' || p_partkey AS id, 'p' || p_partkey AS family_id, p_name AS name, p_name || ' ' || p_brand || ' ' || p_type AS content FROM part
UNION ALL SELECT 's' || s_suppkey, 's' || s_suppkey, s_name, s_name || ' nation ' || s_nationkey FROM supplier""",
    "episodes": """SELECT 'o' || o_orderkey AS id, 'c' || o_custkey AS family_id, o_orderpriority || ' ' || o_orderstatus AS content, o_orderdate AS event_time,
  o_orderdate AS processed_time, 'cust' || o_custkey AS source_document, o_orderpriority AS activity_type FROM orders""",
    "mentions": """SELECT DISTINCT 'o' || l_orderkey AS episode_id, t.target_id, 'entity' AS target_type FROM lineitem, LATERAL (VALUES ('p' || l_partkey), ('s' || l_suppkey)) t(target_id)""",
    "edges": """SELECT *, least(entity1_id, entity2_id) AS fam1, greatest(entity1_id, entity2_id) AS fam2 FROM relations""",
}


def sql(*views: str) -> str:
    """A WITH clause of some views, in an order that suits them."""
    return "WITH RECURSIVE " + ", ".join(f"{v} AS ({SQL[v]})" for v in SQL if v in views or (v == "relations" and "edges" in views))


class Views:
    """The views over one folder of tables; each is a plan, nothing is read here."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    @property
    def entities(self) -> DataFrame:
        rows = self.table("events").select(
            F.concat(F.lit("e"), "event_id").alias("id"), F.concat(F.lit("u"), "user_id").alias("family_id"), F.col("event_type").alias("name"),
            F.concat_ws(" ", "event_type", "props").alias("content"), F.col("ts").cast("timestamp").alias("event_time"), F.col("ts").cast("timestamp").alias("processed_time"),
            F.concat(F.lit("doc"), F.col("event_id") % 50).alias("source_document"), F.round(F.col("value") / 500, 6).alias("confidence"), F.col("props").alias("attributes"),
        )
        return with_validity(rows)

    @property
    def relations(self) -> DataFrame:
        day = F.col("l_shipdate").cast("timestamp")
        part, supplier = F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")
        attributes = F.concat(
            F.lit('{"tier":"candidate","status":"'), F.when(F.col("l_linestatus") == "O", "hypothesized").otherwise("verified"), F.lit('","corroboration_count":"'),
            (F.col("l_linenumber") % 3).cast("string"), F.lit('","dream_cycle_id":"c'), F.col("l_linenumber").cast("string"), F.lit('"}'),
        )
        dream = F.col("l_returnflag") == "R"
        return self.table("lineitem").select(
            F.concat_ws(":", *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")]).alias("id"),
            F.concat_ws("-", part, supplier).alias("family_id"), part.alias("entity1_id"), supplier.alias("entity2_id"),
            F.concat_ws(" ", "l_returnflag", "l_linestatus", F.col("l_quantity").cast("long").cast("string")).alias("content"),
            day.alias("event_time"), day.alias("processed_time"), F.concat(F.lit("o"), "l_orderkey").alias("episode_id"),
            F.when(dream, F.concat(F.lit("dream:c"), "l_linenumber")).otherwise(F.concat(F.lit("doc"), F.col("l_orderkey") % 50)).alias("source_document"),
            F.round(1 - F.col("l_discount"), 6).alias("confidence"), F.when(dream, attributes).alias("attributes"), day.alias("valid_at"),
            F.when((F.col("l_returnflag") == "N") & (F.col("l_linestatus") == "F") & (F.col("l_quantity") < 10), day + F.expr("INTERVAL 90 DAYS")).alias("invalid_at"),
        )

    @property
    def things(self) -> DataFrame:
        p, s = self.table("part"), self.table("supplier")
        part, supplier = F.concat(F.lit("p"), "p_partkey"), F.concat(F.lit("s"), "s_suppkey")
        return p.select(part.alias("id"), part.alias("family_id"), F.col("p_name").alias("name"), F.concat_ws(" ", "p_name", "p_brand", "p_type").alias("content")).unionAll(
            s.select(supplier, supplier, "s_name", F.concat(F.col("s_name"), F.lit(" nation "), F.col("s_nationkey").cast("string")))
        )

    @property
    def episodes(self) -> DataFrame:
        day = F.col("o_orderdate").cast("timestamp")
        return self.table("orders").select(
            F.concat(F.lit("o"), "o_orderkey").alias("id"), F.concat(F.lit("c"), "o_custkey").alias("family_id"), F.concat_ws(" ", "o_orderpriority", "o_orderstatus").alias("content"),
            day.alias("event_time"), day.alias("processed_time"), F.concat(F.lit("cust"), "o_custkey").alias("source_document"), F.col("o_orderpriority").alias("activity_type"),
        )

    @property
    def mentions(self) -> DataFrame:
        ends = F.explode(F.array(F.concat(F.lit("p"), "l_partkey"), F.concat(F.lit("s"), "l_suppkey")))
        return self.table("lineitem").select(F.concat(F.lit("o"), "l_orderkey").alias("episode_id"), ends.alias("target_id"), F.lit("entity").alias("target_type")).distinct()

    @property
    def edges(self) -> DataFrame:
        """Relations whose ends are families of one version each."""
        return self.relations.withColumn("fam1", F.least("entity1_id", "entity2_id")).withColumn("fam2", F.greatest("entity1_id", "entity2_id"))

    @property
    def links(self) -> DataFrame:
        return self.edges.select(F.col("fam1").alias("u"), F.col("fam2").alias("v")).distinct()
