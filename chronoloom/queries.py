"""Registered queries, each with the SQL it is checked against where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from chronoloom.functions import text as tx
from chronoloom.functions import validation as va
from chronoloom.operators import concepts as co
from chronoloom.operators import dream as dr
from chronoloom.operators import episodes as ep
from chronoloom.operators import graph as gr
from chronoloom.operators import relations as re
from chronoloom.operators import resolution as rs
from chronoloom.operators import search as se
from chronoloom.operators import stats as st
from chronoloom.operators import temporal as tm
from chronoloom.operators import writes as wr
from chronoloom.plans.dream_cycle import explore
from chronoloom.plans.remember import remember
from chronoloom.sources.adapters import Views, sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

NOW, MID = "2024-02-01 00:00:00", "2024-01-15 00:00:00"
ASOF = "1998-06-01 00:00:00"
EARLY = "1995-01-20 00:00:00"
NEWEST = "row_number() OVER (PARTITION BY family_id ORDER BY processed_time DESC, id DESC)"
VALID = lambda t: f"(valid_at IS NULL OR valid_at <= TIMESTAMP '{t}') AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{t}')"
HIDDEN = "coalesce(json_extract_string(attributes, '$.tier') = 'candidate' AND coalesce(json_extract_string(attributes, '$.status'), '') <> 'verified', false)"
US = lambda c: F.unix_micros(c).alias(c if isinstance(c, str) else None)


def query(views: tuple[str, ...] = (), oracle: str | None = None, base: bool = True):
    """Registers a function of the views; the oracle may start with further named tables."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if oracle:
            head = sql(*views) if views else ""
            body = oracle.strip()
            if body.startswith(","):
                body = body if head else "WITH RECURSIVE " + body[1:]
            ORACLES[f.__name__] = f"{head} {body}".strip()
        return f

    return put


def us(*columns: str) -> list:
    return [F.unix_micros(c).alias(c) for c in columns]


# --- versions ---------------------------------------------------------------


@query(("entities",), f"SELECT family_id, id, name, epoch_us(processed_time) AS processed_time FROM entities QUALIFY {NEWEST} = 1")
def latest_version(v):
    return tm.latest(v.entities).select("family_id", "id", "name", *us("processed_time"))


@query(("entities",), "SELECT family_id, count(*) AS version_count FROM entities GROUP BY 1")
def version_counts(v):
    return tm.version_counts(v.entities)


@query(("entities",), f"SELECT family_id, id FROM entities WHERE event_time <= TIMESTAMP '{MID}' QUALIFY {NEWEST} = 1")
def asof_event(v):
    return tm.as_of_event(v.entities, MID).select("family_id", "id")


@query(("entities",), f"SELECT family_id, id FROM entities WHERE {VALID(MID)} QUALIFY {NEWEST} = 1")
def asof_valid(v):
    return tm.as_of_valid(v.entities, MID).select("family_id", "id")


@query(("entities",), "SELECT id, epoch_us(valid_at) AS valid_at, coalesce(epoch_us(invalid_at), -1) AS invalid_at FROM entities")
def invalid_intervals(v):
    return v.entities.select("id", *us("valid_at"), F.coalesce(F.unix_micros("invalid_at"), F.lit(-1)).alias("invalid_at"))


@query(("entities", "relations"), f"SELECT 'entity' AS kind, id FROM entities WHERE {VALID(MID)} UNION ALL SELECT 'relation', id FROM relations WHERE {VALID(ASOF)}")
def snapshot(v):
    one = lambda df, t, k: df.where(tm.is_valid(t)).select(F.lit(k).alias("kind"), "id")
    return one(v.entities, MID, "entity").unionAll(one(v.relations, ASOF, "relation"))


@query(("entities",), f"SELECT id FROM entities WHERE event_time BETWEEN TIMESTAMP '{MID}' AND TIMESTAMP '2024-01-16 00:00:00'")
def changes_between(v):
    return tm.changes(v.entities, MID, "2024-01-16 00:00:00").select("id")


@query(("entities",), f"""SELECT family_id, id, round(abs(epoch_us(event_time) - epoch_us(TIMESTAMP '{MID}')) / 1e6, 3) AS delta_seconds FROM entities
QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY abs(epoch_us(event_time) - epoch_us(TIMESTAMP '{MID}')), event_time > TIMESTAMP '{MID}', processed_time DESC, id DESC) = 1""")  # fmt: skip
def nearest_version(v):
    return tm.nearest(v.entities, MID).select("family_id", "id", F.round("delta_seconds", 3).alias("delta_seconds"))


@query(("entities",), f"""SELECT id, CASE WHEN event_time < TIMESTAMP '{MID}' THEN 'before' WHEN event_time > TIMESTAMP '{MID}' THEN 'after' ELSE 'exact' END AS relative_position
FROM entities WHERE event_time BETWEEN TIMESTAMP '{MID}' - INTERVAL 7200 SECOND AND TIMESTAMP '{MID}' + INTERVAL 7200 SECOND""")  # fmt: skip
def around_time(v):
    return tm.around(v.entities, MID, 7200).select("id", "relative_position")


@query(("entities",), """, t AS (SELECT family_id, processed_time, id FROM entities WHERE id = 'e500')
SELECT e.id FROM entities e JOIN t USING (family_id) WHERE (e.processed_time, e.id) <= (t.processed_time, t.id)""")  # fmt: skip
def versions_up_to(v):
    return tm.versions_up_to(v.entities, "e500").select("id")


@query(("entities", "episodes"), """, points AS (SELECT 'u' || user_id AS family_id, ts + INTERVAL 1 HOUR AS at FROM events)
SELECT p.family_id, epoch_us(p.at) AS at, e.id FROM points p ASOF JOIN entities e ON p.family_id = e.family_id AND p.at >= e.event_time""")  # fmt: skip
def asof_join(v):
    points = v.table("events").select(F.concat(F.lit("u"), "user_id").alias("family_id"), (F.col("ts").cast("timestamp") + F.expr("INTERVAL 1 HOUR")).alias("at"))
    return tm.as_of_join(points, v.entities.select("family_id", "id", "event_time", "processed_time")).select("family_id", *us("at"), "id")


@query(("entities",), "SELECT id, name, epoch_us(processed_time) AS processed_time FROM entities WHERE family_id = 'u7'")
def entity_versions(v):
    return tm.versions(v.entities, "u7").select("id", "name", *us("processed_time"))


@query(("entities",), f"""SELECT family_id, id, substr(content, 1, 12) AS snippet, version_count FROM entities JOIN (SELECT family_id, count(*) AS version_count FROM entities GROUP BY 1) USING (family_id)
QUALIFY {NEWEST} = 1""")  # fmt: skip
def latest_projection(v):
    counts = tm.version_counts(v.entities)
    return tm.latest(v.entities).join(counts, "family_id").select("family_id", "id", F.substring("content", 1, 12).alias("snippet"), "version_count")


@query(("entities",), f"SELECT family_id, id FROM (SELECT * FROM entities QUALIFY {NEWEST} = 1) ORDER BY processed_time DESC, id DESC LIMIT 20 OFFSET 10")
def entity_page(v):
    return tm.latest(v.entities).orderBy(F.desc("processed_time"), F.desc("id")).offset(10).limit(20).select("family_id", "id")


@query(("things",), "SELECT name, max(family_id) AS family_id FROM things GROUP BY name")
def families_by_names(v):
    return v.things.groupBy("name").agg(F.max("family_id").alias("family_id"))


@query(("things",), "SELECT family_id FROM things WHERE starts_with(name, 'red')")
def name_prefix(v):
    return v.things.where(F.col("name").startswith("red")).select("family_id")


@query(("entities", "relations"), "SELECT (SELECT count(DISTINCT family_id) FROM entities) AS entities, (SELECT count(DISTINCT family_id) FROM relations) AS relations")
def unique_families(v):
    return v.entities.agg(F.countDistinct("family_id").alias("entities")).join(F.broadcast(v.relations.agg(F.countDistinct("family_id").alias("relations"))))


@query((), "SELECT vec_id, round(embedding[1], 5) AS a, round(embedding[5], 5) AS e, len(embedding[1:5]) AS n FROM embeddings")
def embedding_preview(v):
    part = v.table("embeddings").select("vec_id", F.slice("embedding", 1, 5).alias("p"))
    return part.select("vec_id", F.round(F.get("p", F.lit(0)), 5).alias("a"), F.round(F.get("p", F.lit(4)), 5).alias("e"), F.size("p").cast("long").alias("n"))


# --- relations --------------------------------------------------------------


@query(("relations",), f"SELECT family_id, id, content FROM (SELECT * FROM relations QUALIFY {NEWEST} = 1) WHERE NOT {HIDDEN}")
def latest_relations(v):
    return re.visible(tm.latest(v.relations)).select("family_id", "id", "content")


@query(("relations",), "SELECT family_id, count(*) AS version_count FROM relations GROUP BY 1")
def relation_version_counts(v):
    return tm.version_counts(v.relations)


@query(("edges",), "SELECT fam AS family, count(*) AS degree FROM edges, LATERAL (VALUES (fam1), (fam2)) t(fam) GROUP BY 1")
def degrees(v):
    return re.degrees(v.edges)


@query(("edges",), "SELECT fam AS family, count(DISTINCT family_id) AS degree FROM edges, LATERAL (VALUES (fam1), (fam2)) t(fam) WHERE invalid_at IS NULL GROUP BY 1 ORDER BY degree DESC, family LIMIT 20")
def hub_entities(v):
    return dr.seeds_hub(v.edges, 20).select("family", "degree")


@query(("things", "relations"), f"""SELECT id AS family_id FROM things WHERE id NOT IN (SELECT entity1_id FROM relations WHERE event_time <= TIMESTAMP '{EARLY}' UNION SELECT entity2_id FROM relations WHERE event_time <= TIMESTAMP '{EARLY}')""")
def isolated_entities(v):
    things = v.things.withColumn("processed_time", F.lit(NOW).cast("timestamp")).withColumn("invalid_at", F.lit(None).cast("timestamp"))
    known = v.relations.where(F.col("event_time") <= F.lit(EARLY).cast("timestamp")).withColumn("invalid_at", F.lit(None).cast("timestamp"))
    return re.isolated(things, known).select("family_id")


@query(("edges",), f"SELECT family_id, id FROM (SELECT * FROM edges WHERE fam1 = 'p1' AND fam2 = 's1' QUALIFY {NEWEST} = 1) UNION ALL SELECT family_id, id FROM (SELECT * FROM edges WHERE fam1 = 'p7' AND fam2 = 's7' QUALIFY {NEWEST} = 1)")
def relations_between(v):
    return re.between(v.edges, "s1", "p1", True).unionByName(re.between(v.edges, "p7", "s7", True)).select("family_id", "id")


@query(("edges",), f"""SELECT fam1, fam2, family_id, id FROM edges WHERE invalid_at IS NULL AND (fam1, fam2) IN (SELECT 'p' || ps.p_partkey, 's' || (ps.p_partkey % 50) FROM part ps) QUALIFY {NEWEST} = 1""")
def pair_relations(v):
    part = F.concat(F.lit("p"), "p_partkey")
    pairs = v.table("part").select(F.concat(F.lit("s"), F.col("p_partkey") % 50).alias("left"), part.alias("right"))
    return re.between_pairs(v.edges, pairs).select("fam1", "fam2", "family_id", "id")


@query(("edges",), f"SELECT fam AS family, family_id, id FROM edges, LATERAL (VALUES (fam1), (fam2)) t(fam) WHERE event_time <= TIMESTAMP '{ASOF}' QUALIFY row_number() OVER (PARTITION BY fam, family_id ORDER BY processed_time DESC, id DESC) = 1 AND NOT {HIDDEN}")
def family_relations_asof(v):
    every = v.things.select(F.col("family_id").alias("family"))
    return re.of_families(v.edges, every, ASOF).select("family", "family_id", "id")


@query(("relations",), "SELECT e AS entity_id, string_agg(id, ',' ORDER BY id) AS relation_ids FROM (SELECT DISTINCT unnest([entity1_id, entity2_id]) AS e, id FROM relations) GROUP BY 1")
def referencing_relations(v):
    ids = v.things.select(F.col("id").alias("entity_id"))
    return re.referencing(v.relations, ids).select("entity_id", F.concat_ws(",", "relation_ids").alias("relation_ids"))


@query(("relations",), "SELECT id, family_id, epoch_us(invalid_at) AS invalid_at FROM relations WHERE invalid_at IS NOT NULL")
def invalidated_relations(v):
    return v.relations.where("invalid_at is not null").select("id", "family_id", *us("invalid_at"))


@query(("relations", "things"), "SELECT id AS relation_id, e AS entity_id FROM (SELECT DISTINCT id, unnest([entity1_id, entity2_id]) AS e FROM relations) WHERE e NOT IN (SELECT id FROM things WHERE id LIKE 'p%')")
def dangling_refs(v):
    return re.dangling(v.relations, v.things.where("id like 'p%'")).select("relation_id", "entity_id").distinct()


@query(("relations",), f"""SELECT family_id, id FROM (SELECT * FROM relations WHERE (entity1_id IN ('p3', 'p4') OR entity2_id IN ('p3', 'p4')) AND processed_time <= TIMESTAMP '{ASOF}' QUALIFY {NEWEST} = 1) WHERE NOT {HIDDEN}""")
def relation_timeline(v):
    known = v.spark.createDataFrame([("p3", EARLY), ("p4", ASOF)], "entity_id string, t string").select("entity_id", F.col("t").cast("timestamp").alias("processed_time"))
    return re.timeline(v.relations, known).select("family_id", "id")


@query(("things", "edges"), f"""SELECT t.family_id, count(DISTINCT e.family_id) AS n, count(DISTINCT t.id) AS version_count FROM things t LEFT JOIN (SELECT * FROM edges WHERE invalid_at IS NULL) e0 ON false
LEFT JOIN (SELECT fam, family_id FROM edges, LATERAL (VALUES (fam1), (fam2)) x(fam) WHERE invalid_at IS NULL QUALIFY row_number() OVER (PARTITION BY fam, family_id ORDER BY processed_time DESC, id DESC) = 1 AND NOT {HIDDEN}) e ON e.fam = t.family_id GROUP BY 1""")  # fmt: skip
def entity_profiles(v):
    things = v.things.withColumn("processed_time", F.lit(NOW).cast("timestamp"))
    out = re.profiles(things, v.edges, things.select(F.col("family_id").alias("family")))
    return out.select("family_id", F.size("relation_ids").cast("long").alias("n"), "version_count")


@query(("relations", "things"), "SELECT r.id, a.name AS entity1_name, b.name AS entity2_name FROM relations r LEFT JOIN things a ON a.id = r.entity1_id LEFT JOIN things b ON b.id = r.entity2_id")
def relations_with_names(v):
    return re.with_names(v.relations, v.things).select("id", "entity1_name", "entity2_name")


@query(("mentions", "episodes"), "SELECT target_id, count(*) AS episodes, epoch_us(max(event_time)) AS newest FROM mentions JOIN episodes ON episodes.id = episode_id GROUP BY 1")
def provenance(v):
    joined = v.mentions.join(v.episodes.select(F.col("id").alias("episode_id"), "event_time"), "episode_id")
    return joined.groupBy("target_id").agg(F.count("*").alias("episodes"), F.unix_micros(F.max("event_time")).alias("newest"))


# --- search -----------------------------------------------------------------

_BM25 = """, words AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]+') AS w FROM documents),
counted AS (SELECT doc_id, len(w) AS n, len(list_filter(w, lambda x: x = 'ander')) AS t0, len(list_filter(w, lambda x: x = 'the')) AS t1, len(list_filter(w, lambda x: x = 'thtion')) AS t2 FROM words),
stats AS (SELECT count(*) AS d, avg(n) AS a, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1, count(*) FILTER (t2 > 0) AS d2 FROM counted)
SELECT doc_id, round(0.0 + ln(1 + (d - d0 + 0.5) / (d0 + 0.5)) * t0 * 2.2 / (t0 + 1.2 * (0.25 + 0.75 * n / a)) + ln(1 + (d - d1 + 0.5) / (d1 + 0.5)) * t1 * 2.2 / (t1 + 1.2 * (0.25 + 0.75 * n / a))
 + ln(1 + (d - d2 + 0.5) / (d2 + 0.5)) * t2 * 2.2 / (t2 + 1.2 * (0.25 + 0.75 * n / a)), 6) AS score FROM counted, stats WHERE t0 > 0 OR t1 > 0 OR t2 > 0 ORDER BY score DESC, doc_id LIMIT 20"""


@query((), _BM25)
def bm25_documents(v):
    return se.bm25(v.table("documents"), "doc_id", "text", "the thtion ander", 20)


@query((), """SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\\pL\\pN_]+')) AS term FROM documents) GROUP BY ALL""")
def inverted_index(v):
    return se.inverted_index(v.table("documents"), "doc_id", "text").select("doc_id", "term", F.col("tf").cast("long").alias("tf"))


_COSINE = "round(list_dot_product(e.embedding, q.embedding) / (sqrt(list_dot_product(e.embedding, e.embedding)) * sqrt(list_dot_product(q.embedding, q.embedding)) + 1e-9), 4)"


@query((), f"""SELECT q.item AS query_id, e.vec_id, {_COSINE} AS score FROM embeddings e, (SELECT vec_id AS item, embedding FROM embeddings WHERE vec_id % 100 = 0) q
QUALIFY row_number() OVER (PARTITION BY q.item ORDER BY round(list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) / (sqrt(list_dot_product(e.embedding::DOUBLE[], e.embedding::DOUBLE[])) * sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) + 1e-9), 6) DESC, e.vec_id) <= 5""".replace(_COSINE, _COSINE.replace("embedding", "embedding::DOUBLE[]")))  # fmt: skip
def knn_vectors(v):
    rows = v.table("embeddings")
    queries = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return se.knn_join(queries, rows, "vec_id", "query_id", 5).select("query_id", "vec_id", F.round("score", 4).alias("score"))


_GRAMS = "list_distinct([substr({0}, i, 2) for i in range(1, length({0}))])"
_JACCARD = "round(CASE WHEN {0} = {1} THEN 1.0 ELSE len(list_intersect(" + _GRAMS.format("{0}") + ", " + _GRAMS.format("{1}") + "))::DOUBLE / len(list_distinct(list_concat(" + _GRAMS.format("{0}") + ", " + _GRAMS.format("{1}") + "))) END, 6)"


@query(("things",), f"SELECT family_id, {_JACCARD.format('lower(name)', chr(39) + 'red widget' + chr(39))} AS score FROM things WHERE {_JACCARD.format('lower(name)', chr(39) + 'red widget' + chr(39))} >= 0.3 ORDER BY score DESC, family_id LIMIT 100")
def jaccard_search(v):
    return se.by_similarity(v.things, "red widget", 0.3, 100, "jaccard")


@query(("things",), f"""SELECT family_id, round(sqrt(len(list_intersect(list_distinct(string_split('red widget', '')), list_distinct(string_split(lower(name), ''))))::DOUBLE / 8 * len(list_intersect({_GRAMS.format("'red widget'")}, {_GRAMS.format('lower(name)')}))::DOUBLE / len({_GRAMS.format("'red widget'")})), 6) AS score
FROM things WHERE score >= 0.4 ORDER BY score DESC, family_id LIMIT 100""")  # fmt: skip
def bleu_search(v):
    return se.by_similarity(v.things, "red widget", 0.4, 100, "bleu")


@query()
def sequence_search(v):
    return se.by_similarity(v.things, "red widgit", 0.6, 50, "text")


@query((), """SELECT doc_id AS id, (length(lower(text)) - length(replace(lower(text), 'that', ''))) // 4 AS score FROM documents WHERE contains(lower(text), 'that') ORDER BY score DESC, id LIMIT 20""")
def substring_search(v):
    docs = v.table("documents").select(F.col("doc_id").alias("id"), F.col("text").alias("content"), F.lit(NOW).cast("timestamp").alias("event_time"))
    return se.occurrences(docs, "that").select("id", "score")


@query((), "SELECT doc_id FROM documents WHERE contains(lower(text), 'the') AND contains(lower(text), 'ander') AND contains(lower(text), 'ing')")
def keyword_search(v):
    return se.all_keywords(v.table("documents"), ["the", "ander", "ing"], "text").select("doc_id")


_ARMS = """, bm AS (SELECT family_id, row_number() OVER (ORDER BY degree DESC, family_id) - 1 AS rank FROM (SELECT fam AS family_id, count(*) AS degree FROM edges, LATERAL (VALUES (fam1), (fam2)) t(fam) GROUP BY 1)),
ve AS (SELECT family_id, row_number() OVER (ORDER BY c DESC, family_id) - 1 AS rank FROM (SELECT fam AS family_id, sum((confidence * 100)::BIGINT) AS c FROM edges, LATERAL (VALUES (fam1), (fam2)) t(fam) WHERE invalid_at IS NULL GROUP BY 1))"""


def _arms(v):
    ends = v.edges.select(F.explode(F.array("fam1", "fam2")).alias("family_id"), "confidence", "invalid_at")
    a = ends.groupBy("family_id").agg(F.count("*").alias("score"))
    b = ends.where("invalid_at is null").groupBy("family_id").agg(F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("score"))
    return a, b


@query(("edges",), _ARMS + """, s AS (SELECT family_id, sum(w) AS s FROM (SELECT family_id, 0.3 / (61 + rank) AS w FROM bm UNION ALL SELECT family_id, 0.7 / (61 + rank) FROM ve) GROUP BY 1)
SELECT family_id, round(s / (SELECT max(s) FROM s), 4) AS score FROM s""")  # fmt: skip
def rank_fusion(v):
    a, b = _arms(v)
    return se.fuse([(se.ranked(a), 0.3), (se.ranked(b), 0.7)])


@query(("things", "edges"), """, d AS (SELECT fam, count(*) AS degree FROM edges, LATERAL (VALUES (fam1), (fam2)) t(fam) GROUP BY 1),
j AS (SELECT family_id, 1.0 / (1 + length(name)) AS score, coalesce(degree, 0) AS degree FROM things LEFT JOIN d ON fam = family_id)
SELECT family_id, round(score * 0.7 + 0.3 * degree / (SELECT greatest(max(degree), 1) FROM j), 6) AS score FROM j""")  # fmt: skip
def degree_rerank(v):
    rows = v.things.select("family_id", (F.lit(1.0) / (1 + F.length("name"))).alias("score"))
    return se.degree_rerank(rows, re.degrees(v.edges)).select("family_id", "score")


@query(("entities",), f"""SELECT id, round((1 - 0.2 + 0.2 * coalesce(nullif(confidence, 0), 0.5)) * exp(-ln(2) * greatest((epoch_us(TIMESTAMP '{NOW}') - epoch_us(event_time)) / 86400000000.0, 0) / 90), 6) AS score FROM entities""")
def confidence_rerank(v):
    return se.confidence_rerank(v.entities.withColumn("score", F.lit(1.0)), NOW, half_life_days=90.0).select("id", "score")


@query()
def hybrid_search(v):
    vectors = v.table("embeddings").join(v.table("embeddings").where("vec_id = 0").select(F.col("embedding").alias("q"))).select(
        F.concat(F.lit("p"), "vec_id").alias("family_id"), F.round(tx.cosine("embedding", "q"), 6).alias("score")
    )
    return se.hybrid(v.things, "red widget", vectors.orderBy(F.desc("score"), "family_id").limit(40))


@query()
def unified_find(v):
    things = v.things.withColumn("event_time", F.lit(MID).cast("timestamp")).withColumn("confidence", F.lit(0.8))
    return se.unified_find(things, tm.latest(v.edges), "red widget", NOW)


@query()
def find_by_name(v):
    return se.name_chain(v.things, "Red Widget", 20)


# --- graph ------------------------------------------------------------------

_LINKS = "links AS (SELECT DISTINCT fam1 AS u, fam2 AS v FROM edges), near AS (SELECT u, v FROM links UNION SELECT v, u FROM links)"


@query(("edges",), f""", {_LINKS}, walk(id, hop) AS (SELECT 'p1', 0 UNION SELECT near.v, hop + 1 FROM walk JOIN near ON near.u = walk.id WHERE hop < 2)
SELECT id, min(hop) AS hop FROM walk GROUP BY 1""")  # fmt: skip
def bfs(v):
    return gr.bfs(v.links, v.spark.createDataFrame([("p1",)], "id string"), 2)


@query(("edges",), f""", {_LINKS}, two AS (SELECT a.v AS m FROM near a JOIN near b ON a.v = b.u WHERE a.u = 'p1' AND b.v = 'p2')
SELECT 'p1>' || m || '>p2' AS path, 2 AS length FROM two ORDER BY path LIMIT 10""")  # fmt: skip
def shortest_paths(v):
    return gr.shortest_paths(v.links, "p1", "p2", separator=">").select(F.concat_ws(">", "path").alias("path"), "length")


@query(("edges",), f""", e AS (SELECT DISTINCT fam1 AS u, fam2 AS v FROM edges WHERE event_time <= TIMESTAMP '{EARLY}'), near AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach(id, c) AS (SELECT DISTINCT u, u FROM near UNION SELECT near.v, c FROM reach JOIN near ON near.u = reach.id) SELECT id, min(c) AS component FROM reach GROUP BY 1""")  # fmt: skip
def components(v):
    known = v.edges.where(F.col("event_time") <= F.lit(EARLY).cast("timestamp"))
    return gr.components(known.select(F.col("fam1").alias("u"), F.col("fam2").alias("v")))


@query(("edges",), f""", {_LINKS}, nodes AS (SELECT 'p1' AS id UNION SELECT v FROM near WHERE u = 'p1') SELECT u, v FROM links WHERE u IN (SELECT id FROM nodes) AND v IN (SELECT id FROM nodes)""")
def ego_network(v):
    return gr.ego_network(v.links, "p1", 1)[1]


@query()
def communities(v):
    known = v.edges.select(F.col("fam1").alias("u"), F.col("fam2").alias("v")).distinct()
    return gr.communities(gr.label_propagation(known)).select("community_id", "size", F.concat_ws(",", "members").alias("members"))


@query((), """SELECT 'n' || n_nationkey AS source_family_id, 'r' || n_regionkey AS target_family_id FROM nation UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey""")
def redirect_closure(v):
    day = F.lit(NOW).cast("timestamp").alias("updated_at")
    a = v.table("customer").select(F.concat(F.lit("c"), "c_custkey").alias("source_family_id"), F.concat(F.lit("n"), "c_nationkey").alias("target_family_id"), day)
    b = v.table("nation").select(F.concat(F.lit("n"), "n_nationkey").alias("source_family_id"), F.concat(F.lit("r"), "n_regionkey").alias("target_family_id"), day)
    return gr.redirect_closure(a.unionAll(b))


# --- statistics -------------------------------------------------------------


@query(("things", "relations"), """, ends AS (SELECT entity1_id AS id FROM relations UNION ALL SELECT entity2_id FROM relations), d AS (SELECT id, count(*) AS d FROM ends GROUP BY 1),
e AS (SELECT count(*) AS entity_versions, count(DISTINCT family_id) AS entity_families FROM things), r AS (SELECT count(*) AS relation_versions, count(DISTINCT family_id) AS relation_families FROM relations)
SELECT entity_versions, entity_families, relation_versions, relation_families, (SELECT round(avg(d), 6) FROM d) AS avg_degree, (SELECT max(d) FROM d) AS max_degree,
 (SELECT count(DISTINCT family_id) FROM things WHERE id NOT IN (SELECT id FROM ends)) AS isolated_families, round(relation_families / (entity_families * (entity_families - 1) / 2), 4) AS density FROM e, r""")  # fmt: skip
def graph_statistics(v):
    return st.graph_statistics(v.things, v.relations)


@query(("entities",), "SELECT strftime(event_time, '%Y-%m-%d') AS day, count(*) AS n FROM entities GROUP BY 1 ORDER BY 1 LIMIT 30")
def daily_counts(v):
    return st.daily_counts(v.entities).select(F.col("day").cast("string").alias("day"), "n")


@query(("things", "relations"), """SELECT (SELECT count(*) FROM things) AS valid_entities, 0 AS invalid_entities, 0 AS nameless_entities, count(*) FILTER (invalid_at IS NULL) AS valid_relations,
count(*) FILTER (invalid_at IS NOT NULL) AS invalid_relations, 0 AS dangling_ends FROM relations""")  # fmt: skip
def quality_report(v):
    return st.quality_report(v.things.withColumn("invalid_at", F.lit(None).cast("timestamp")), v.relations)


@query(("relations",), "SELECT e AS entity_id, count(*) AS degree FROM (SELECT unnest(list_distinct([entity1_id, entity2_id])) AS e FROM relations) GROUP BY 1 ORDER BY degree DESC, entity_id LIMIT 10")
def key_nodes(v):
    return st.key_nodes(v.relations)


def _requests(v):
    return v.table("events").select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), F.col("value").alias("latency"))


@query((), """SELECT count(*) AS requests, round(avg((event_type = 'error')::DOUBLE), 6) AS error_rate, round(avg(value), 6) AS avg_latency, max(value) AS max_latency, round(count(*) / 1440.0, 6) AS per_minute
FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00'""")  # fmt: skip
def request_metrics(v):
    return st.request_metrics(_requests(v), MID, 86_400)


@query((), "SELECT event_type AS path, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
def top_paths(v):
    return st.top_paths(_requests(v))


@query(("relations", "things"), """SELECT 'discover_relations' AS rule, 'high' AS priority WHERE (SELECT count(DISTINCT family_id) FROM relations WHERE event_time <= TIMESTAMP '1995-01-20') < 0.3 * (SELECT count(*) FROM things)
UNION ALL SELECT 'connect_isolated', 'high' WHERE (SELECT count(*) FROM things WHERE id NOT IN (SELECT entity1_id FROM relations WHERE event_time <= TIMESTAMP '1995-01-20' UNION SELECT entity2_id FROM relations WHERE event_time <= TIMESTAMP '1995-01-20')) > 20""")  # fmt: skip
def recommendations(v):
    known = v.relations.where(F.col("event_time") <= F.lit(EARLY).cast("timestamp"))
    return st.recommendations(st.graph_statistics(v.things, known))


# --- concepts ---------------------------------------------------------------

_CONCEPTS = """, concepts AS (SELECT id, family_id, 'entity' AS role, NULL::TIMESTAMP AS valid_at, NULL::TIMESTAMP AS invalid_at, attributes FROM (SELECT *, NULL AS attributes FROM things)
UNION ALL SELECT id, family_id, 'relation', valid_at, invalid_at, attributes FROM relations UNION ALL SELECT id, family_id, 'observation', NULL, NULL, NULL FROM episodes)"""


def _concepts(v):
    day = F.lit("1990-01-01").cast("timestamp")
    return co.concepts(v.things.withColumn("processed_time", day).withColumn("event_time", day), v.relations, v.episodes)


@query(("things", "relations", "episodes"), _CONCEPTS + f" SELECT role, count(*) AS n FROM concepts WHERE {VALID(ASOF)} GROUP BY 1")
def concept_counts(v):
    return co.count(_concepts(v), ASOF)


@query(("things", "relations", "episodes"), _CONCEPTS + f""" SELECT id FROM concepts WHERE role = 'relation' AND NOT coalesce(json_extract_string(attributes, '$.tier') = 'candidate' AND json_extract_string(attributes, '$.status') = 'hypothesized', false) AND {VALID(ASOF)}""")
def concept_list(v):
    rows = _concepts(v)
    return rows.where((F.col("role") == "relation") & ~co.hidden_hypothesis() & tm.is_valid(ASOF)).select("id")


@query(("relations", "things"), """, newest AS (SELECT * FROM relations QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY processed_time DESC, id DESC) = 1)
SELECT DISTINCT e AS family_id, family_id AS neighbour FROM (SELECT family_id, unnest([entity1_id, entity2_id]) AS e FROM newest) WHERE e LIKE 's%'""")  # fmt: skip
def concept_neighbours(v):
    return co.neighbours(_concepts(v), v.mentions, v.things.where("family_id like 's%'").select("family_id"))


@query(("mentions", "episodes"), "SELECT DISTINCT target_id AS family_id, episode_id, epoch_us(event_time) AS event_time FROM mentions JOIN episodes ON episodes.id = episode_id WHERE target_id LIKE 's%'")
def concept_provenance(v):
    out = co.provenance(_concepts(v), v.mentions, v.episodes, v.things.where("family_id like 's%'").select("family_id"))
    return out.select("family_id", "episode_id", *us("event_time"))


# --- dream ------------------------------------------------------------------


@query(("entities",), f"SELECT id FROM (SELECT * FROM entities WHERE invalid_at IS NULL QUALIFY {NEWEST} = 1) WHERE confidence < 0.5 ORDER BY confidence, id LIMIT 15")
def seeds_low_confidence(v):
    return dr.seeds_low_confidence(v.entities, 15).select("id")


@query(("entities",), f"SELECT id FROM (SELECT * FROM entities WHERE invalid_at IS NULL QUALIFY {NEWEST} = 1) WHERE epoch_us(TIMESTAMP '{NOW}') - epoch_us(processed_time) > 2 * 86400000000 ORDER BY processed_time, id LIMIT 15")
def seeds_time_gap(v):
    return dr.seeds_time_gap(v.entities, NOW, 15, 2).select("id")


@query(("entities",), f"SELECT id FROM (SELECT * FROM entities WHERE invalid_at IS NULL QUALIFY {NEWEST} = 1) ORDER BY md5('7|' || family_id), family_id LIMIT 15")
def seeds_random(v):
    return dr.seeds_random(v.entities, 15, 7).select("id")


@query()
def seeds_cross_community(v):
    known = v.edges.where(F.col("event_time") <= F.lit(EARLY).cast("timestamp"))
    return dr.seeds_cross_community(known, 10)


_CAND = f"cand AS (SELECT * FROM (SELECT * FROM relations WHERE invalid_at IS NULL QUALIFY {NEWEST} = 1) WHERE json_extract_string(attributes, '$.tier') IN ('candidate', 'verified', 'rejected') AND source_document LIKE 'dream%')"


@query(("relations",), f", {_CAND} SELECT family_id, id, json_extract_string(attributes, '$.status') AS status FROM cand")
def candidate_relations(v):
    return dr.candidates(v.relations).select("family_id", "id", F.get_json_object("attributes", "$.status").alias("status"))


@query(("relations",), f", {_CAND} SELECT family_id, greatest(confidence, 0.7) AS confidence, 'verified' AS status, (json_extract_string(attributes, '$.corroboration_count')::INT + 1)::VARCHAR AS n FROM cand WHERE json_extract_string(attributes, '$.status') = 'hypothesized'")
def promoted_candidates(v):
    out = dr.promote(dr.candidates(v.relations, "hypothesized"), NOW)
    return out.select("family_id", "confidence", F.get_json_object("attributes", "$.status").alias("status"), F.get_json_object("attributes", "$.corroboration_count").alias("n"))


@query(("relations",), f", {_CAND} SELECT family_id, least(confidence, 0.2) AS confidence, 'rejected' AS status FROM cand WHERE json_extract_string(attributes, '$.status') = 'hypothesized' AND json_extract_string(attributes, '$.dream_cycle_id') = 'c3'")
def rejected_cycle(v):
    return dr.reject_cycle(v.relations, "c3", NOW).select("family_id", "confidence", F.get_json_object("attributes", "$.status").alias("status"))


@query(("edges",), """, hits AS (SELECT fam1, fam2, count(*) AS h FROM edges WHERE source_document NOT LIKE 'dream%' GROUP BY ALL), pairs AS (SELECT DISTINCT fam1, fam2 FROM edges)
SELECT fam1, fam2, coalesce(h, 0) AS corroboration_count, CASE WHEN coalesce(h, 0) >= 2 THEN 'verified' ELSE 'hypothesized' END AS status,
round(CASE WHEN coalesce(h, 0) >= 2 THEN greatest(least(0.4 + 0.1 * h, 0.69), 0.7) WHEN h IS NULL THEN 0.4 ELSE least(0.4 + 0.1 * h, 0.69) END, 6) AS confidence FROM pairs LEFT JOIN hits USING (fam1, fam2)""")  # fmt: skip
def corroborated_pairs(v):
    pairs = v.edges.select("fam1", "fam2").distinct().withColumn("corroboration_count", F.lit(0)).withColumn("status", F.lit("hypothesized")).withColumn("confidence", F.lit(0.4))
    return dr.corroborate(pairs, v.edges.where(~F.col("source_document").startswith("dream")).select("fam1", "fam2"))


# --- writes -----------------------------------------------------------------


@query(("entities",), f"""SELECT id, CASE WHEN {NEWEST} = 1 THEN round(greatest(least(confidence + 0.05 - 0.1, 1.0), 0.0), 6) ELSE confidence END AS confidence FROM entities""")
def adjusted_confidence(v):
    kinds = v.spark.createDataFrame([("corroboration",), ("contradiction",)], "kind string")
    evidence = v.entities.select("family_id").distinct().join(F.broadcast(kinds))
    return wr.adjust_confidence(v.entities, evidence).select("id", "confidence")


@query(("entities",), "SELECT id FROM entities WHERE NOT coalesce(invalid_at < TIMESTAMP '2024-01-15', false)")
def purged_versions(v):
    return wr.purge_invalid(v.entities, MID).select("id")


@query(("entities",), "SELECT CASE WHEN family_id IN ('u2', 'u3') THEN 'u1' ELSE family_id END AS family_id, count(*) AS n FROM entities GROUP BY 1")
def merged_families(v):
    redirects = v.spark.createDataFrame([], "source_family_id string, target_family_id string, updated_at timestamp")
    return wr.merge_families(v.entities, redirects, "u1", ["u2", "u3"], NOW)[0].groupBy("family_id").agg(F.count("*").alias("n"))


@query(("entities",), f"SELECT id, CASE WHEN {NEWEST} = 1 THEN 'sum ' || family_id ELSE name END AS name FROM entities")
def updated_summaries(v):
    changes = v.entities.select("family_id").distinct().select("family_id", F.concat(F.lit("sum "), "family_id").alias("value"))
    return wr.update_newest(v.entities, changes, "name").select("id", "name")


@query(("entities",), "SELECT id FROM entities WHERE family_id NOT IN ('u1', 'u5')")
def deleted_families(v):
    return wr.delete(v.entities, v.spark.createDataFrame([("u1",), ("u5",)], "family_id string"), "family_id").select("id")


# --- episodes, text, resolution ---------------------------------------------


@query((), """, d AS (SELECT doc_id, text, length(text) AS n, CASE WHEN length(text) > 0 THEN 1 + ceil(greatest(length(text) - 1000, 0) / 800)::INT ELSE 0 END AS total FROM documents)
SELECT doc_id, w AS window, total, w * 800 AS start, least(w * 800 + 1000, n) AS "end", md5(substr(text, w * 800 + 1, 1000)) AS chunk_md5 FROM (SELECT *, unnest(range(0, total)) AS w FROM d)""")  # fmt: skip
def text_windows(v):
    return ep.windows(v.table("documents"), "doc_id", "text").select("doc_id", "window", "total", "start", "end", F.md5("chunk").alias("chunk_md5"))


@query((), "SELECT substr(md5(text), 1, 12) AS doc_hash, min(doc_id) AS first, count(*) AS n FROM documents GROUP BY 1, length(text) HAVING count(*) > 1")
def repeated_texts(v):
    return ep.repeated_texts(v.table("documents"), "doc_id", "text").select("doc_hash", "first", "n")


@query(("episodes",), "SELECT id, epoch_us(event_time) AS event_time FROM episodes ORDER BY event_time DESC, id DESC LIMIT 20 OFFSET 5")
def episode_page(v):
    return ep.page(v.episodes, 20, 5).select("id", *us("event_time"))


@query(("episodes",), "SELECT activity_type, max_by(id, (event_time, id)) AS id FROM episodes GROUP BY 1")
def latest_episode_by_activity(v):
    return v.episodes.groupBy("activity_type").agg(F.max_by("id", F.struct("event_time", "id")).alias("id"))


@query(("episodes",), "SELECT e.id, f.first AS family_id FROM episodes e JOIN (SELECT source_document, min_by(id, (processed_time, id)) AS first FROM episodes GROUP BY 1) f USING (source_document)")
def episode_families(v):
    return ep.family_by_source(v.episodes).select("id", "family_id")


@query(("mentions", "things"), "SELECT episode_id, target_id, family_id FROM mentions JOIN things ON things.id = target_id")
def episode_targets(v):
    ids = v.episodes.select(F.col("id").alias("episode_id"))
    none = v.relations.where("false").select("id", "family_id")
    return ep.targets(v.mentions, v.things, none, ids).select("episode_id", "target_id", "family_id")


@query(("things",), "SELECT trim(regexp_replace(name, '[（(][^）)]+[）)]', '', 'g')) AS core, count(DISTINCT family_id) AS families FROM things GROUP BY 1 HAVING count(DISTINCT family_id) >= 2")
def duplicate_names(v):
    return rs.duplicate_names(v.things).select("core", "families")


@query(("things",), "SELECT trim(name) AS core, max_by(name, (length(content), name, content)) AS name, max_by(content, (length(content), name, content)) AS content FROM things GROUP BY 1")
def deduped_entities(v):
    return rs.dedupe_entities(v.things)


@query(("relations", "things"), """, r AS (SELECT least(a.name, b.name) AS name1, greatest(a.name, b.name) AS name2, r.content FROM relations r JOIN things a ON a.id = r.entity1_id JOIN things b ON b.id = r.entity2_id WHERE a.name <> b.name)
SELECT name1, name2, substr(md5(lower(trim(content))), 1, 12) AS content_hash, min(content) AS content FROM r GROUP BY ALL""")  # fmt: skip
def deduped_relations(v):
    named = re.with_names(v.relations, v.things).select(F.col("entity1_name").alias("name1"), F.col("entity2_name").alias("name2"), "content")
    return rs.dedupe_relations(named)


_NAMES = "names AS (SELECT DISTINCT name FROM things WHERE id LIKE 'p%')"


@query(("things",), f""", {_NAMES}, j AS (SELECT a.name AS left_name, b.name AS right_name, {_JACCARD.format('a.name', 'b.name')} AS jac, a.name = b.name AS same,
 CASE WHEN a.name <> b.name AND (contains(a.name, b.name) OR contains(b.name, a.name)) THEN least(0.65 + 0.30 * least(length(a.name), length(b.name)) / greatest(length(a.name), length(b.name)), 0.95) ELSE 0 END AS sub FROM names a, names b)
SELECT left_name, right_name, round(CASE WHEN same THEN 1.0 ELSE greatest(jac, sub) END, 6) AS score FROM j WHERE round(CASE WHEN same THEN 1.0 ELSE greatest(jac, sub) END, 6) >= 0.5
QUALIFY row_number() OVER (PARTITION BY left_name ORDER BY round(CASE WHEN same THEN 1.0 ELSE greatest(jac, sub) END, 6) DESC, right_name) <= 5""")  # fmt: skip
def candidate_table(v):
    names = v.things.where("id like 'p%'").select("name").distinct()
    return rs.candidate_table(names, names, 0.5, 5).select("left_name", "right_name", "score")


@query(("things", "edges"), f"SELECT family_id FROM things WHERE family_id NOT IN (SELECT fam1 FROM edges WHERE event_time <= TIMESTAMP '{EARLY}' UNION SELECT fam2 FROM edges WHERE event_time <= TIMESTAMP '{EARLY}')")
def orphaned_entities(v):
    return rs.orphans(v.things, v.edges.where(F.col("event_time") <= F.lit(EARLY).cast("timestamp")))


_CH = "list_sort(list_distinct(string_split(lower(trim(content)), '')))"


@query(("things",), f""", sets AS (SELECT DISTINCT {_CH} AS s, min(id) OVER (PARTITION BY {_CH}) AS rep FROM things),
l AS (SELECT a.rep AS u, b.rep AS v FROM sets a, sets b WHERE len(list_intersect(a.s, b.s))::DOUBLE / len(list_distinct(list_concat(a.s, b.s))) > 0.85),
reach(id, c) AS (SELECT rep, rep FROM sets UNION SELECT l.v, c FROM reach JOIN l ON l.u = reach.id), g AS (SELECT id, min(c) AS grp FROM reach GROUP BY 1)
SELECT t.id, g.grp AS "group" FROM things t JOIN sets ON sets.s = {_CH.replace('content', 't.content')} JOIN g ON g.id = sets.rep""")  # fmt: skip
def similar_contents(v):
    return rs.similar_contents(v.things, 0.85)


@query(("entities",), f""", o AS (SELECT *, lag(name) OVER (PARTITION BY family_id ORDER BY processed_time, id) AS prev FROM entities)
SELECT id, CASE WHEN prev IS NULL THEN 'added' WHEN prev = name THEN 'unchanged' ELSE 'modified' END AS change_type FROM o""")  # fmt: skip
def section_history(v):
    run = Window.partitionBy("family_id").orderBy("processed_time", "id")
    body = tx.sections(F.concat(F.lit("## Kind\n"), F.col("name"), F.lit("\n")))
    rows = v.entities.withColumn("new", body).withColumn("old", F.coalesce(F.lag("new").over(run), F.create_map().cast("map<string,string>")))
    return rows.select("id", F.explode(tx.section_changes(F.col("old"), F.col("new"))).alias("c")).select("id", "c.change_type")


@query((), "SELECT doc_id, substr(md5(text), 1, 12) AS doc_hash, substr(sha256(text), 1, 16) AS section_hash FROM documents")
def text_hashes(v):
    return v.table("documents").select("doc_id", tx.doc_hash("text").alias("doc_hash"), tx.section_hash("text").alias("section_hash"))


# --- more operators ---------------------------------------------------------


@query(("entities",), """, t AS (SELECT processed_time AS pt, id AS tid FROM entities WHERE id = 'e500'), own AS (SELECT e.id, CASE WHEN e.id = tid THEN 0 WHEN (e.processed_time, e.id) < (pt, tid) THEN 1 ELSE 2 END AS place
FROM entities e, t WHERE e.family_id = (SELECT family_id FROM entities WHERE id = 'e500')), r AS (SELECT 'g' || (event_id % 7) AS family_id, 'e' || event_id AS eid FROM events)
SELECT r.family_id, CASE min(place) WHEN 0 THEN 'current' WHEN 1 THEN 'inherited' ELSE 'future' END AS scope FROM r JOIN own ON own.id = r.eid GROUP BY 1""")  # fmt: skip
def relation_scope(v):
    ev = v.table("events")
    own = v.entities
    family = own.where("id = 'e500'").select("family_id").first()[0]
    edges = ev.select(F.concat(F.lit("x"), "event_id").alias("id"), F.concat(F.lit("g"), F.col("event_id") % 7).alias("family_id"), F.concat(F.lit("e"), "event_id").alias("entity1_id"), F.lit("none").alias("entity2_id"), F.col("ts").cast("timestamp").alias("processed_time"))
    return re.scope_tags(edges, own, family, "e500").select("family_id", "scope")


@query(("things", "relations"), f"SELECT id FROM things WHERE id NOT IN (SELECT entity1_id FROM relations WHERE event_time <= TIMESTAMP '{EARLY}' UNION SELECT entity2_id FROM relations WHERE event_time <= TIMESTAMP '{EARLY}') ORDER BY id DESC LIMIT 25")
def seeds_orphan(v):
    things = v.things.withColumn("processed_time", F.lit(NOW).cast("timestamp")).withColumn("invalid_at", F.lit(None).cast("timestamp"))
    known = v.relations.where(F.col("event_time") <= F.lit(EARLY).cast("timestamp")).withColumn("invalid_at", F.lit(None).cast("timestamp"))
    return dr.seeds_orphan(things, known, 25).select("id")


@query(("relations",), f"SELECT id, coalesce(epoch_us(CASE WHEN family_id IN ('p1-s1', 'p7-s7') AND invalid_at IS NULL THEN TIMESTAMP '{NOW}' ELSE invalid_at END), -1) AS invalid_at FROM relations")
def invalidated_families(v):
    hit = v.spark.createDataFrame([("p1-s1",), ("p7-s7",)], "family_id string")
    return wr.invalidate(v.relations, hit, NOW).select("id", F.coalesce(F.unix_micros("invalid_at"), F.lit(-1)).alias("invalid_at"))


@query(("entities",), "SELECT id, CASE WHEN id = 'e500' THEN 'new' ELSE family_id END AS family_id FROM entities")
def split_version(v):
    return wr.split_version(v.entities, "e500", "new").select("id", "family_id")


@query(("relations",), "SELECT id, replace(entity1_id, 'p1', 'p1') AS entity1_id, CASE WHEN entity2_id = 's1' THEN 's2' ELSE entity2_id END AS entity2_id FROM relations")
def redirected_ends(v):
    things = v.things.withColumn("processed_time", F.lit(NOW).cast("timestamp"))
    return wr.redirect_ends(v.relations, things, "s1", "s2").select("id", "entity1_id", "entity2_id")


@query(("mentions",), "SELECT episode_id, target_id, CASE WHEN target_id LIKE 's%' THEN 'new' ELSE 'old' END AS mention_context FROM mentions")
def upserted_mentions(v):
    old = v.mentions.withColumn("mention_context", F.lit("old"))
    return wr.upsert_mentions(old, v.mentions.where("target_id like 's%'").withColumn("mention_context", F.lit("new"))).select("episode_id", "target_id", "mention_context")


@query(("entities",), "SELECT id FROM entities UNION ALL SELECT 'x' || event_id FROM events WHERE event_type = 'error'")
def appended_versions(v):
    new = v.entities.where("name = 'error'").withColumn("id", F.concat(F.lit("x"), F.substring("id", 2, 20)))
    return wr.append_versions(v.entities, new.unionAll(v.entities.where("name = 'click'"))).select("id")


@query(("relations", "things"), """, r AS (SELECT least(a.name, b.name) AS name1, greatest(a.name, b.name) AS name2, r.content FROM relations r JOIN things a ON a.id = r.entity1_id JOIN things b ON b.id = r.entity2_id WHERE a.name <> b.name)
SELECT name1, name2, max_by(content, (length(content), content)) AS content FROM r GROUP BY ALL""")  # fmt: skip
def longest_hints(v):
    named = re.with_names(v.relations, v.things).select(F.col("entity1_name").alias("name1"), F.col("entity2_name").alias("name2"), "content")
    return rs.longest_hint(named)


@query(("relations", "things"), """, r AS (SELECT least(a.name, b.name) AS name1, greatest(a.name, b.name) AS name2, r.content, min(r.id) AS pos FROM relations r JOIN things a ON a.id = r.entity1_id JOIN things b ON b.id = r.entity2_id WHERE a.name <> b.name GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY name1, name2 ORDER BY pos, content) AS n FROM r) SELECT name1, name2, string_agg(content, '；' ORDER BY n) AS content FROM k WHERE n <= 3 GROUP BY ALL""")  # fmt: skip
def merged_contents(v):
    named = re.with_names(v.relations, v.things).select(F.col("entity1_name").alias("name1"), F.col("entity2_name").alias("name2"), "content", F.col("id").alias("pos"))
    return rs.merge_contents(named)


@query(("things",), "SELECT core, min(name) AS name FROM (SELECT name, name AS core, row_number() OVER (PARTITION BY name ORDER BY id) AS n FROM things) WHERE n = 1 GROUP BY 1")
def deduped_names(v):
    return rs.dedupe_names(v.things.withColumn("pos", F.col("id")))


_SIM = "round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[])) + 1e-9), 6)"


@query((), f"""SELECT 'v' || a.vec_id AS source_family_id, 'v' || b.vec_id AS target_family_id FROM embeddings a JOIN (SELECT label, min_by(embedding, 'v' || vec_id) AS embedding, min(vec_id::VARCHAR) AS vec_id FROM embeddings GROUP BY 1) b USING (label)
WHERE a.vec_id::VARCHAR <> b.vec_id AND {_SIM} >= 0.75""")  # fmt: skip
def merged_across_windows(v):
    rows = v.table("embeddings").select(F.concat(F.lit("v"), "vec_id").alias("family_id"), F.col("label").cast("string").alias("name"), "embedding", F.lit(1).alias("version_count"))
    return rs.merge_across_windows(rows).select("source_family_id", "target_family_id")


@query(("edges",), f""", e AS (SELECT DISTINCT fam1 AS u, fam2 AS v FROM edges), n AS (SELECT u AS id FROM e UNION SELECT v FROM e), l AS (SELECT id, left(id, 2) AS c FROM n)
SELECT a.c AS community_id, u, v FROM e JOIN l a ON a.id = u JOIN l b ON b.id = v WHERE a.c = b.c""")  # fmt: skip
def community_edges(v):
    ids = v.links.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("community_id", F.substring("id", 1, 2))
    return gr.community_edges(v.links, ids)


@query(("edges",), """, e AS (SELECT DISTINCT fam1 AS u, fam2 AS v FROM edges), m AS (SELECT count(*) AS m FROM e), p AS (SELECT left(u, 2) AS cu, left(v, 2) AS cv FROM e),
d AS (SELECT c, count(*) AS d FROM (SELECT cu AS c FROM p UNION ALL SELECT cv FROM p) GROUP BY 1), i AS (SELECT cu AS c, count(*) AS l FROM p WHERE cu = cv GROUP BY 1)
SELECT round(sum(coalesce(l, 0) / m - (d / (2 * m)) ^ 2), 6) AS modularity FROM d LEFT JOIN i USING (c), m""")  # fmt: skip
def modularity(v):
    ids = v.links.select(F.explode(F.array("u", "v")).alias("id")).distinct().withColumn("community_id", F.substring("id", 1, 2))
    return gr.modularity(v.links, ids).select(F.round("modularity", 6).alias("modularity"))


@query(("edges",), f""", e AS (SELECT DISTINCT fam1 AS u, fam2 AS v FROM edges WHERE event_time <= TIMESTAMP '{EARLY}'), near AS (SELECT u, v FROM e UNION SELECT v, u FROM e),
reach AS (SELECT u AS seed, v AS f FROM near UNION SELECT a.u, b.v FROM near a JOIN near b ON a.v = b.u), pairs AS (SELECT DISTINCT least(seed, f) AS fam1, greatest(seed, f) AS fam2 FROM reach WHERE seed LIKE 's%' AND seed <> f)
SELECT fam1, fam2 FROM pairs WHERE (fam1, fam2) NOT IN (SELECT u, v FROM e)""")  # fmt: skip
def unchecked_pairs(v):
    known = v.edges.where(F.col("event_time") <= F.lit(EARLY).cast("timestamp"))
    seeds = known.select(F.col("fam2").alias("family_id")).distinct()
    reach = explore(known.select(F.col("fam1").alias("u"), F.col("fam2").alias("v")), seeds, 2)
    return dr.unchecked_pairs(seeds, reach, known, v.spark.createDataFrame([], "fam1 string, fam2 string"))


@query()
def remembered_documents(v):
    none = v.spark.createDataFrame([], "family_id string, name string")
    return remember(v.table("documents"), none, NOW)[0].select("family_id", "name")


@query((), "SELECT doc_id, CASE WHEN contains(lower(text), 'ander') THEN substr(text, greatest(strpos(lower(text), 'ander') - 20, 1), 41 - greatest(21 - strpos(lower(text), 'ander'), 0) - 1) ELSE substr(text, 1, 40) END AS hit FROM documents")
def context_snippets(v):
    return v.table("documents").select("doc_id", tx.snippet("text", ["ander"], 20).alias("hit"))


TOLD = [(1, "colleague"), (2, " Colleagues "), (3, "works for the harbour office"), (4, "A is related to B"), (5, "there is a connection between Ada and Bob"), (6, "甲与乙有关"), (7, "甲在乙的公司任职五年"), (8, "short"), (9, None), (10, "related by blood to the late queen of the north"), (11, "Ada and Bob are linked"), (12, "同事关系")]


@query(("relations",), """SELECT id, length(content) >= 8 AS valid FROM relations UNION ALL SELECT 'told' || n, ok FROM (VALUES (1, false), (2, false), (3, true), (4, false), (5, false), (6, false), (7, true), (8, false), (9, false),
 (10, true), (11, false), (12, false)) t(n, ok)""")  # fmt: skip
def valid_relation_contents(v):
    told = v.spark.createDataFrame(TOLD, "n int, content string").select(F.concat(F.lit("told"), "n").alias("id"), "content")
    return v.relations.select("id", "content").unionAll(told).select("id", va.valid_relation_content("content").alias("valid"))


@query((), "SELECT event_type AS strategy, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY 1")
def metric_summary(v):
    return st.metric_summary(v.table("events").withColumnRenamed("event_type", "strategy"), ["strategy"], "value").select("strategy", "n", "mean", "std")


FLAGSHIP = "hub_entities"


from chronoloom import more_queries, graph_queries, proposal_queries  # noqa: E402, F401, I001  register further queries
