"""Registered queries on saved proposals, seeds by strategy and look-ups through redirects."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronoloom.operators import proposals as pr
from chronoloom.queries import NEWEST, NOW, query


def _redirects(v, table, key, old, new):
    """Every fifth row of a table had another id before."""
    k = F.col(key)
    return v.table(table).where(k % 5 == 0).select(F.concat(F.lit(old), k).alias("source_family_id"), F.concat(F.lit(new), k).alias("target_family_id")).distinct()


_PAIR = "least(a, b) AS fam1, greatest(a, b) AS fam2"


@query(("edges", "things"), f"""
, props AS (SELECT 'p' || p_partkey AS a, 's' || (p_partkey % 13) AS b, p_type AS content, p_size / 50.0::DOUBLE AS confidence FROM part
    UNION ALL SELECT entity2_id, entity1_id, content || ' again', 0.75::DOUBLE FROM relations WHERE split_part(id, ':', 2) = '1'
    UNION ALL SELECT entity1_id, entity2_id, content, confidence FROM relations WHERE split_part(id, ':', 2) = '2'),
texts AS (SELECT {_PAIR}, content, max(confidence) AS c FROM props GROUP BY ALL),
old AS (SELECT fam1, fam2, family_id, entity1_id, entity2_id, content AS was, confidence, attributes FROM edges WHERE invalid_at IS NULL QUALIFY row_number() OVER (PARTITION BY fam1, fam2 ORDER BY processed_time DESC, id DESC) = 1),
folded AS (SELECT fam1, fam2, max(c) AS c, any_value(was) AS was, string_agg(content, chr(10) || '[Dream update] ' ORDER BY c DESC, content) FILTER (was IS NULL OR content <> was) AS said FROM texts LEFT JOIN old USING (fam1, fam2) GROUP BY 1, 2),
named AS (SELECT folded.*, x.name AS name1, y.name AS name2, x.id IS NOT NULL AND y.id IS NOT NULL AS known FROM folded LEFT JOIN things x ON x.family_id = fam1 LEFT JOIN things y ON y.family_id = fam2)
SELECT fam1, fam2, CASE WHEN NOT known THEN 'unknown' WHEN named.was IS NOT NULL THEN 'merged' ELSE 'created' END AS action,
    CASE WHEN known THEN coalesce(family_id, 'rel_' || substr(md5(fam1 || '|' || fam2), 1, 12)) END AS family_id,
    CASE WHEN known THEN coalesce(entity1_id, CASE WHEN name1 <= name2 THEN fam1 ELSE fam2 END) END AS entity1_id,
    CASE WHEN known THEN concat_ws(chr(10) || '[Dream update] ', named.was, said) END AS content,
    CASE WHEN known THEN CASE WHEN named.was IS NOT NULL THEN greatest(confidence, c) ELSE least(c, 0.5) END END AS confidence,
    CASE WHEN NOT known THEN NULL WHEN named.was IS NULL THEN 'c77' ELSE json_extract_string(attributes, '$.dream_cycle_id') END AS cycle,
    CASE WHEN known AND named.was IS NOT NULL THEN 'c77' END AS added
FROM named LEFT JOIN old USING (fam1, fam2)""")  # fmt: skip
def saved_proposals(v):
    """Proposals on old and new ids, for pairs with and without a relation, some with an unknown end."""
    k = F.col("p_partkey")
    part = F.when(k % 5 == 0, F.concat(F.lit("old"), k)).otherwise(F.concat(F.lit("p"), k))
    line = F.split("id", ":")[1]
    new = v.table("part").select(part.alias("entity1_id"), F.concat(F.lit("s"), k % 13).alias("entity2_id"), F.col("p_type").alias("content"), (F.col("p_size") / 50.0).alias("confidence"))
    again = v.relations.where(line == "1").select(F.col("entity2_id").alias("entity1_id"), F.col("entity1_id").alias("entity2_id"), F.concat("content", F.lit(" again")).alias("content"), F.lit(0.75).alias("confidence"))
    same = v.relations.where(line == "2").select("entity1_id", "entity2_id", "content", "confidence")
    out = pr.save(new.unionAll(again).unionAll(same), v.things.withColumn("processed_time", F.lit(NOW).cast("timestamp")), v.edges, _redirects(v, "part", "p_partkey", "old", "p"), "c77", NOW)
    return out.select(
        "fam1", "fam2", "action", "family_id", "entity1_id", "content", "confidence",
        F.get_json_object("attributes", "$.dream_cycle_id").alias("cycle"), F.get_json_object("attributes", f"$.{pr.ADDED}").alias("added"),
    )


_VALID = f"now AS (SELECT * FROM (SELECT * FROM entities WHERE invalid_at IS NULL AND family_id NOT IN (SELECT family_id FROM gone) QUALIFY {NEWEST} = 1))"


@query(("entities", "edges"), f"""
, gone AS (SELECT 'u' || c_custkey AS family_id FROM customer WHERE c_custkey % 4 = 0 UNION ALL SELECT 's' || s_suppkey FROM supplier WHERE s_suppkey % 4 = 0), {_VALID},
ends AS (SELECT DISTINCT family_id AS relation, unnest([fam1, fam2]) AS family_id FROM edges WHERE invalid_at IS NULL),
hubs AS (SELECT family_id, count(*) AS n FROM ends WHERE family_id NOT IN (SELECT family_id FROM gone) GROUP BY 1)
SELECT * FROM (SELECT family_id, 'random' AS reason FROM now ORDER BY md5('3|' || family_id), family_id LIMIT 12)
UNION ALL SELECT * FROM (SELECT family_id, 'hub' FROM hubs ORDER BY n DESC, family_id LIMIT 12)
UNION ALL SELECT * FROM (SELECT family_id, 'low_confidence' FROM now WHERE confidence < 0.5 ORDER BY confidence, id LIMIT 12)
UNION ALL SELECT * FROM (SELECT family_id, 'time_gap' FROM now WHERE processed_time < TIMESTAMP '2024-06-01' - INTERVAL 30 DAY ORDER BY processed_time, id LIMIT 12)
UNION ALL SELECT * FROM (SELECT family_id, 'orphan' FROM now ORDER BY processed_time DESC, id DESC LIMIT 12)""")  # fmt: skip
def seeds_by_strategy(v):
    gone = v.table("customer").where("c_custkey % 4 = 0").select(F.concat(F.lit("u"), "c_custkey").alias("family_id"))
    gone = gone.unionAll(v.table("supplier").where("s_suppkey % 4 = 0").select(F.concat(F.lit("s"), "s_suppkey")))
    parts = [pr.seeds(s, v.entities, v.edges, 12, exclude=gone, now="2024-06-01 00:00:00", seed=3) for s in ("random", "hub", "low_confidence", "time_gap", "orphan")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


@query(("entities",), f""", now AS (SELECT * FROM entities QUALIFY {NEWEST} = 1)
SELECT asked, family_id, id FROM (SELECT family_id AS asked, * FROM now UNION ALL SELECT 'old' || substr(family_id, 2), * FROM now WHERE substr(family_id, 2)::BIGINT % 5 = 0)""")  # fmt: skip
def versions_by_asked_ids(v):
    """Newest versions by present, former and unknown ids."""
    users = v.table("events").select("user_id").distinct()
    asked = users.select(F.explode(F.array(F.concat(F.lit("u"), "user_id"), F.concat(F.lit("old"), "user_id"))).alias("asked"))
    return pr.by_asked_ids(v.entities, asked, _redirects(v, "events", "user_id", "old", "u")).select("asked", "family_id", "id")
