"""Registered queries on similarity joins, the vector index, endpoints and candidates."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from chronoloom.functions import name_rules as nr
from chronoloom.functions import text as tx
from chronoloom.functions.text import strip
from chronoloom.operators import endpoints as en
from chronoloom.operators import incremental as inc
from chronoloom.operators import resolution as rs
from chronoloom.operators import retrieval as rt
from chronoloom.operators import temporal as tm
from chronoloom.operators import traversal as tv
from chronoloom.operators import unified as uf
from chronoloom.operators import upkeep as up
from chronoloom.operators import vectors as vx
from chronoloom.operators.episodes import windows
from chronoloom.plans import align as al
from chronoloom.plans.remember import capitalised
from chronoloom.streaming import documents as dc
from chronoloom.more_queries import _AGED, _CORE, _NOW_REL, _PROBE, _STRIP, bm25_sql, rank_sql
from chronoloom.queries import _JACCARD, ASOF, EARLY, MID, NEWEST, NOW, ORACLES, _concepts, query
from chronoloom.sources.adapters import sql

# --- vector index -----------------------------------------------------------


def _probes(v):
    return v.table("embeddings").where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


@query((), ORACLES["knn_vectors"])
def knn_indexed(v):
    index = vx.build(v.table("embeddings"), "vec_id")
    return vx.search(index, _probes(v), "query_id", 5, exact=True).select("query_id", "vec_id", F.round("score", 4).alias("score"))


@query()
def knn_probed(v):
    """The approximate search; a test measures its recall."""
    index = vx.build(v.table("embeddings"), "vec_id")
    return vx.search(index, _probes(v), "query_id", 5, probes=32).select("query_id", "vec_id", F.round("score", 4).alias("score"))


_COS = lambda a, b: f"round(list_dot_product({a}::DOUBLE[], {b}::DOUBLE[]) / (sqrt(list_dot_product({a}::DOUBLE[], {a}::DOUBLE[])) * sqrt(list_dot_product({b}::DOUBLE[], {b}::DOUBLE[])) + 1e-9), 6)"


@query((), f"SELECT a.vec_id AS query_id, b.vec_id, {_COS('a.embedding', 'b.embedding')} AS score FROM embeddings a, embeddings b WHERE a.vec_id % 100 = 0 AND {_COS('a.embedding', 'b.embedding')} >= 0.25")
def vectors_within(v):
    return vx.within(vx.build(v.table("embeddings"), "vec_id"), _probes(v), "query_id", 0.25)


_RELATION_HITS = """, rvec AS (SELECT family_id, round(embedding[1]::DOUBLE / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9), 6) AS score FROM nowrel JOIN embeddings ON 'p' || vec_id = entity1_id ORDER BY score DESC, family_id LIMIT {0})"""


def _relation_hits(v, limit):
    """Nearest relations to a probe; a relation has its part's vector."""
    own = v.table("embeddings").select(F.concat(F.lit("p"), "vec_id").alias("entity1_id"), "embedding")
    index = vx.build(rt.visible(v.relations).select("family_id", "entity1_id").join(own, "entity1_id"), "family_id")
    probe = v.spark.createDataFrame([(1, _PROBE)], "q int, embedding array<double>")
    return vx.search(index, probe, "q", limit, exact=True).select("family_id", "score")


@query(("relations",), _NOW_REL + _RELATION_HITS.format(20) + f""", f AS (SELECT family_id, 1 - 0.01 * (row_number() OVER (ORDER BY score DESC, family_id) - 1) AS s FROM rvec)
SELECT family_id, round(s * {_AGED}, 6) AS score FROM f JOIN nowrel USING (family_id)""")  # fmt: skip
def relations_by_vector(v):
    return rt.find_relations(v.relations, "", NOW, "vector", 20, _relation_hits(v, 20))


@query(("relations",), _NOW_REL + _RELATION_HITS.format(40) + bm25_sql("nowrel", "family_id", "content", ["r", "36"], 40, "hits") + f""", f AS (SELECT family_id, sum(w) AS w FROM ({rank_sql('hits', 0.3)} UNION ALL {rank_sql('rvec', 0.7)}) GROUP BY 1),
t AS (SELECT family_id, round(w / (SELECT max(w) FROM f), 4) AS s FROM f ORDER BY s DESC, family_id LIMIT 20) SELECT family_id, round(s * {_AGED}, 6) AS score FROM t JOIN nowrel USING (family_id)""")  # fmt: skip
def relations_hybrid(v):
    return rt.find_relations(v.relations, "r 36", NOW, "hybrid", 20, _relation_hits(v, 40))


# --- candidates by names and vectors ----------------------------------------

# Extracted rows: parts whose name is changed by number, with the vector of the part's number and of the next one.
_EXTRACTED = """, ext AS (SELECT p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || ' (new)' WHEN 2 THEN 'old ' || p_name ELSE p_brand END AS name, a.embedding AS nv, b.embedding AS fv
FROM part JOIN embeddings a ON a.vec_id = p_partkey JOIN embeddings b ON b.vec_id = (p_partkey + 1) % 100), kn AS (SELECT 'p' || p_partkey AS family_id, p_name AS name, embedding AS e FROM part JOIN embeddings ON vec_id = p_partkey),
sc AS (SELECT pos, family_id, ext.name AS a, kn.name AS b, {core_a} AS ca, {core_b} AS cb, greatest({cos_n}, {cos_f}) AS dense_score FROM ext, kn),
lx AS (SELECT *, round(CASE WHEN a = b THEN 1.0 ELSE greatest({jac}, CASE WHEN ca = cb THEN 0.85 WHEN ca <> '' AND cb <> '' AND (contains(ca, cb) OR contains(cb, ca)) THEN least(0.65 + 0.30 * least(length(ca), length(cb)) / greatest(length(ca), length(cb)), 0.95) ELSE 0 END) END, 6) AS lexical_score FROM sc),
cd AS (SELECT pos, family_id, lexical_score, dense_score, greatest(lexical_score, dense_score) AS score, (ca = cb AND ca <> '') OR (dense_score >= 0.85 AND lexical_score >= 0.5) AS merge_safe FROM lx WHERE lexical_score >= 0.6 OR dense_score >= 0.4),
top AS (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY score DESC, family_id)::INTEGER AS rank FROM cd QUALIFY rank <= 10)""".format(
    core_a="lower(" + _CORE("ext.name") + ")", core_b="lower(" + _CORE("kn.name") + ")", cos_n=_COS("nv", "e"), cos_f=_COS("fv", "e"), jac=_JACCARD.format("lower(a)", "lower(b)")
)


def _extracted(v):
    vec = v.table("embeddings")
    kind = F.col("p_partkey") % 4
    name = F.when(kind == 0, F.upper("p_name")).when(kind == 1, F.concat("p_name", F.lit(" (new)"))).when(kind == 2, F.concat(F.lit("old "), "p_name")).otherwise(F.col("p_brand"))
    rows = v.table("part").select(F.col("p_partkey").alias("pos"), name.alias("name"))
    own = rows.join(vec.select(F.col("vec_id").alias("pos"), F.col("embedding").alias("name_vector")), "pos")
    return own.join(vec.select(F.col("vec_id").alias("_n"), F.col("embedding").alias("full_vector")), F.col("_n") == (F.col("pos") + 1) % 100).drop("_n")


def _known(v):
    vec = v.table("embeddings").select(F.concat(F.lit("p"), "vec_id").alias("family_id"), "embedding")
    return v.things.join(vec, "family_id").select("family_id", "name", "content", "embedding")


@query((), _EXTRACTED + " SELECT pos, family_id, lexical_score, dense_score, score, merge_safe, rank FROM top")
def candidates_by_name_and_vector(v):
    return rs.entity_candidates(_extracted(v), _known(v), dense=0.4)


# --- ends of relations ------------------------------------------------------

_CATALOGUE = """, cat AS (SELECT name, max(place) AS place FROM (SELECT p_name AS name, p_partkey AS place FROM part UNION ALL SELECT s_name, s_suppkey FROM supplier
UNION ALL SELECT p_name || ' (' || p_type || ')', p_partkey FROM part WHERE p_partkey % 25 = 0) GROUP BY 1)"""
_HINTS = """, hints AS (SELECT p_partkey AS pos, CASE p_partkey % 9 WHEN 0 THEN p_name WHEN 1 THEN upper(p_name) WHEN 2 THEN p_name || ' (kept)' WHEN 3 THEN 'Supplier#0000000' || (p_partkey % 10) || '0x' WHEN 4 THEN split_part(p_name, ' ', 1)
 WHEN 5 THEN 'very ' || p_name WHEN 6 THEN '' WHEN 7 THEN p_brand ELSE 'Supplier#00000000' || (p_partkey % 10) END AS name1, 'Supplier#00000000' || (p_size % 10) AS name2, p_type AS content FROM part
UNION ALL SELECT 1000000 + doc_id, split_part(coalesce(text, ''), ' ', 1), source, substr(text, 1, 40) FROM documents)"""


def _catalogue(v):
    p, s = v.table("part"), v.table("supplier")
    noted = p.where("p_partkey % 25 = 0").select(F.concat(F.col("p_name"), F.lit(" ("), F.col("p_type"), F.lit(")")), "p_partkey")
    return p.select(F.col("p_name").alias("name"), F.col("p_partkey").alias("place")).unionAll(s.select("s_name", "s_suppkey")).unionAll(noted)


def _hints(v):
    p, kind = v.table("part"), F.col("p_partkey") % 9
    end = F.concat(F.lit("Supplier#00000000"), F.col("p_partkey") % 10)
    one = (
        F.when(kind == 0, F.col("p_name")).when(kind == 1, F.upper("p_name")).when(kind == 2, F.concat("p_name", F.lit(" (kept)"))).when(kind == 3, F.concat(F.lit("Supplier#0000000"), F.col("p_partkey") % 10, F.lit("0x")))
        .when(kind == 4, F.split_part("p_name", F.lit(" "), F.lit(1))).when(kind == 5, F.concat(F.lit("very "), "p_name")).when(kind == 6, F.lit("")).when(kind == 7, F.col("p_brand")).otherwise(end)
    )
    told = p.select(F.col("p_partkey").alias("pos"), one.alias("name1"), F.concat(F.lit("Supplier#00000000"), F.col("p_size") % 10).alias("name2"), F.col("p_type").alias("content"))
    return told.unionAll(v.table("documents").select(1000000 + F.col("doc_id"), F.split_part(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(1)), "source", F.substring("text", 1, 40)))


def _pick(stage: str, pairs: str, open_: str) -> str:
    """A stage's table: of each raw end the best known name."""
    return f"""st_{stage} AS (SELECT raw, arg_max(name, (score, noted, place, length(name), name)) AS name, '{stage}' AS stage FROM (SELECT p.raw, p.name, p.score, regexp_matches(p.name, '[（(][^）)]+[）)]')::INT AS noted, cat.place FROM ({pairs}) p JOIN cat ON cat.name = p.name) GROUP BY raw),
{open_} AS (SELECT * FROM {{0}} WHERE raw NOT IN (SELECT raw FROM st_{stage}))"""


_KN = f", kn AS (SELECT name, lower(name) AS folded, lower({_CORE('name')}) AS core FROM cat), ends AS (SELECT DISTINCT raw, lower(raw) AS folded, lower({_CORE('raw')}) AS core FROM (SELECT {_STRIP('name1')} AS raw FROM h UNION ALL SELECT {_STRIP('name2')} FROM h) WHERE raw <> '')"
_STAGED = (
    _KN
    + ", " + _pick("exact", "SELECT raw, name, 1.0 AS score FROM ends JOIN kn ON raw = name", "o1").format("ends")
    + ", " + _pick("folded", "SELECT raw, name, 1.0 AS score FROM o1 JOIN kn USING (folded)", "o2").format("o1")
    + ", " + _pick("core", "SELECT raw, name, 1.0 AS score FROM o2 JOIN kn USING (core) WHERE core <> ''", "o3").format("o2")
    + f""", cc AS (SELECT a, b, {_JACCARD.format('a', 'b')} AS jac, CASE WHEN contains(a, b) OR contains(b, a) THEN least(length(a), length(b))::DOUBLE / greatest(length(a), length(b)) ELSE 0 END AS ratio
 FROM (SELECT DISTINCT core AS a FROM o3 WHERE length(core) >= 2) x, (SELECT DISTINCT core AS b FROM kn WHERE length(core) >= 2) y), """
    + _pick("overlap", "SELECT raw, name, greatest(jac, ratio) AS score FROM cc JOIN o3 ON o3.core = a JOIN kn ON kn.core = b WHERE greatest(jac, ratio) >= 0.9", "o4").format("o3")
    + """, hb AS (SELECT a, min(b) AS b, count(*) AS n FROM (SELECT * FROM cc WHERE ratio > 0 QUALIFY ratio = max(ratio) OVER (PARTITION BY a)) GROUP BY a), """
    + _pick("inside", "SELECT raw, name, 1.0 AS score FROM o4 JOIN hb ON a = o4.core JOIN kn ON kn.core = b WHERE n = 1", "o5").format("o4")
    + """, settled AS (SELECT * FROM st_exact UNION ALL SELECT * FROM st_folded UNION ALL SELECT * FROM st_core UNION ALL SELECT * FROM st_overlap UNION ALL SELECT * FROM st_inside
UNION ALL SELECT raw, NULL, CASE WHEN core IN (SELECT a FROM hb WHERE n > 1) THEN 'ambiguous' ELSE 'unknown' END FROM o5)"""
)


@query((), _CATALOGUE + _HINTS + ", h AS (SELECT * FROM hints)" + _STAGED + " SELECT raw, name, stage FROM settled")
def resolved_ends(v):
    h = _hints(v)
    return en.resolved(h.select(F.explode(F.array("name1", "name2")).alias("raw")), _catalogue(v)).select("raw", "name", "stage")


_REPORT = (
    _CATALOGUE + _HINTS
    + f", t AS (SELECT pos, {_STRIP('name1')} AS raw1, {_STRIP('name2')} AS raw2, {_STRIP('content')} AS content FROM hints), h AS (SELECT raw1 AS name1, raw2 AS name2 FROM t WHERE raw1 <> '' AND raw2 <> '' AND raw1 <> raw2)"
    + _STAGED
    + """, j AS (SELECT t.*, a.name AS n1, b.name AS n2, a.stage AS stage1, b.stage AS stage2, CASE WHEN raw1 = '' OR raw2 = '' THEN 'missing_endpoint' WHEN raw1 = raw2 THEN 'self_relation' WHEN a.name IS NULL OR b.name IS NULL THEN 'unknown_endpoint' WHEN a.name = b.name THEN 'self_relation' END AS reason
 FROM t LEFT JOIN settled a ON a.raw = raw1 LEFT JOIN settled b ON b.raw = raw2), good AS (SELECT *, least(n1, n2) AS x, greatest(n1, n2) AS y FROM j WHERE reason IS NULL),
jd AS (SELECT *, row_number() OVER o AS place, max(length(content)) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS longest FROM good WINDOW o AS (PARTITION BY x, y ORDER BY pos))"""
)


@query((), _REPORT + " SELECT x AS name1, y AS name2, content, pos, stage1, stage2 FROM good QUALIFY row_number() OVER (PARTITION BY x, y ORDER BY length(content) DESC, pos) = 1")
def relation_hints_kept(v):
    return en.candidates_report(_hints(v), _catalogue(v))[0]


@query((), _REPORT + """ SELECT pos, raw1, raw2, CASE WHEN reason IN ('missing_endpoint') OR raw1 = raw2 THEN NULL ELSE stage1 END AS stage1, CASE WHEN reason IN ('missing_endpoint') OR raw1 = raw2 THEN NULL ELSE stage2 END AS stage2, reason FROM j WHERE reason IS NOT NULL
UNION ALL SELECT pos, raw1, raw2, stage1, stage2, CASE WHEN length(content) > longest THEN 'duplicate_pair_replaced_shorter_hint' ELSE 'duplicate_pair' END FROM jd WHERE place > 1""")  # fmt: skip
def relation_hints_report(v):
    rows = en.candidates_report(_hints(v), _catalogue(v))[1]
    early = F.col("reason").isin("missing_endpoint") | (F.col("raw1") == F.col("raw2"))
    return rows.select("pos", "raw1", "raw2", F.when(~early, F.col("stage1")).alias("stage1"), F.when(~early, F.col("stage2")).alias("stage2"), "reason")


# The rules on contents are checked by ``valid_relation_contents``; these contents are long enough and name no relation.
_CHECKED = f""", told AS (SELECT pos, {_STRIP('name1')} AS a, {_STRIP('name2')} AS b, content FROM (SELECT pos, name1, name2, CASE WHEN pos % 2 = 0 THEN 'told of ' || content WHEN pos % 3 = 0 THEN content ELSE 'Told of ' || content END AS content FROM hints WHERE pos < 1000000)),
jr AS (SELECT pos, least(a, b) AS name1, greatest(a, b) AS name2, content, CASE WHEN a = '' OR b = '' THEN 'missing_endpoint' WHEN a = b THEN 'self_relation' WHEN a NOT IN (SELECT name FROM cat) OR b NOT IN (SELECT name FROM cat) THEN 'unknown_endpoint' WHEN length(content) < 8 THEN 'invalid_content' END AS reason FROM told),
pl AS (SELECT *, row_number() OVER (PARTITION BY name1, name2, substr(md5(lower(content)), 1, 12) ORDER BY pos) AS place FROM jr WHERE reason IS NULL)"""


def _checked(v):
    rows = _hints(v).where("pos < 1000000")
    content = F.when(F.col("pos") % 2 == 0, F.concat(F.lit("told of "), "content")).when(F.col("pos") % 3 == 0, F.col("content")).otherwise(F.concat(F.lit("Told of "), "content"))
    return en.extracted_report(rows.withColumn("content", content), _catalogue(v))


@query((), _CATALOGUE + _HINTS + _CHECKED + " SELECT pos, name1, name2, content FROM pl WHERE place = 1")
def relations_checked(v):
    return _checked(v)[0]


@query((), _CATALOGUE + _HINTS + _CHECKED + " SELECT pos, name1, name2, reason FROM jr WHERE reason IS NOT NULL UNION ALL SELECT pos, name1, name2, 'duplicate_relation' FROM pl WHERE place > 1")
def relations_checked_report(v):
    return _checked(v)[1].select("pos", "name1", "name2", "reason")


@query((), f""", best AS (SELECT 'vec ' || e.vec_id AS raw, s_name AS name, {_COS('e.embedding', 'k.embedding')} AS score FROM embeddings e, supplier JOIN embeddings k ON k.vec_id = s_suppkey)
SELECT 'vec ' || vec_id AS raw, name, CASE WHEN name IS NULL THEN 'unknown' ELSE 'vector' END AS stage FROM embeddings LEFT JOIN (SELECT * FROM best WHERE score >= 0.35 QUALIFY row_number() OVER (PARTITION BY raw ORDER BY score DESC, name) = 1) b ON b.raw = 'vec ' || vec_id""")  # fmt: skip
def ends_by_vector(v):
    vec = v.table("embeddings")
    raws = vec.select(F.concat(F.lit("vec "), "vec_id").alias("raw"), "embedding")
    names = v.table("supplier").select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("place"))
    own = v.table("supplier").join(vec, F.col("vec_id") == F.col("s_suppkey")).select(F.col("s_name").alias("name"), "embedding")
    return en.resolved(raws, names, inside=False, vectors=(raws, own), nearest=0.35).select("raw", "name", "stage")


# --- incremental maintenance ------------------------------------------------

SINCE, UNTIL = "2024-01-15 00:00:00", "2024-01-18 00:00:00"
# Meetings of users: each event with the next one; a fifth of them end after five days.  One user in fifty is merged into the next one by UNTIL.
_MEET = """, meet AS (SELECT 'm' || a.event_id AS id, 'm' || (a.event_id % 997) AS family_id, 'e' || a.event_id AS entity1_id, 'e' || b.event_id AS entity2_id, a.event_type AS content, greatest(a.ts, b.ts) AS processed_time,
CASE WHEN a.event_id % 5 = 0 THEN greatest(a.ts, b.ts) + INTERVAL 5 DAY END AS invalid_at FROM events a JOIN events b ON b.event_id = a.event_id + 1),
moved AS (SELECT DISTINCT 'u' || user_id AS s, 'u' || (user_id + 1) AS t FROM events WHERE user_id % 50 = 7)"""


def _edges_sql(name: str, t: str, merged: bool) -> str:
    family = "coalesce(moved.t, family_id)" if merged else "family_id"
    return f""", ent_{name} AS (SELECT id, {family} AS family_id, processed_time, invalid_at IS NULL OR invalid_at > TIMESTAMP '{t}' AS open FROM entities LEFT JOIN moved ON moved.s = family_id WHERE processed_time <= TIMESTAMP '{t}'),
cur_{name} AS (SELECT family_id, id FROM ent_{name} WHERE open QUALIFY row_number() OVER (PARTITION BY family_id ORDER BY processed_time DESC, id DESC) = 1),
full_{name} AS (SELECT m.id AS relation_id, m.family_id, a.family_id AS fam1, b.family_id AS fam2, ca.id AS source_id, cb.id AS target_id, m.content FROM meet m JOIN ent_{name} a ON a.id = entity1_id JOIN ent_{name} b ON b.id = entity2_id
 JOIN cur_{name} ca ON ca.family_id = a.family_id JOIN cur_{name} cb ON cb.family_id = b.family_id WHERE m.processed_time <= TIMESTAMP '{t}' AND (m.invalid_at IS NULL OR m.invalid_at > TIMESTAMP '{t}') AND a.family_id <> b.family_id)"""


def _meetings(v):
    e = v.table("events").select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    b = e.select((F.col("event_id") - 1).alias("event_id"), F.col("ts").alias("next_ts"))
    at = F.greatest("ts", "next_ts")
    return e.join(b, "event_id").select(
        F.concat(F.lit("m"), "event_id").alias("id"), F.concat(F.lit("m"), F.col("event_id") % 997).alias("family_id"), F.concat(F.lit("e"), "event_id").alias("entity1_id"),
        F.concat(F.lit("e"), F.col("event_id") + 1).alias("entity2_id"), F.col("event_type").alias("content"), at.alias("processed_time"), F.when(F.col("event_id") % 5 == 0, at + F.expr("INTERVAL 5 DAYS")).alias("invalid_at"),
    )


def _moved(v):
    users = v.table("events").where("user_id % 50 = 7").select("user_id").distinct()
    return users.select(F.concat(F.lit("u"), "user_id").alias("source_family_id"), F.concat(F.lit("u"), F.col("user_id") + 1).alias("target_family_id"))


def _refresh(v):
    """Edges before the batch, and what the batch does to them."""
    relations, entities, moved = _meetings(v), v.entities, _moved(v)
    old = inc.current_edges(inc.known_at(relations, SINCE), inc.known_at(entities, SINCE))
    changed = [inc.feed(rows, SINCE, UNTIL) for rows in (relations, entities)]
    now = [inc.known_at(rows, UNTIL) for rows in (relations, entities)]
    return old, inc.refresh_edges(old, *now, *changed, moved, moved)


_BOTH = _MEET + _edges_sql("a", SINCE, False) + _edges_sql("b", UNTIL, True)


@query(("entities",), _BOTH + " SELECT * FROM full_b")
def edges_refreshed(v):
    return inc.applied(*_refresh(v), "relation_id")


@query(("entities",), _BOTH + " SELECT *, 'delete' AS op FROM (FROM full_a EXCEPT FROM full_b) UNION ALL SELECT *, 'insert' FROM (FROM full_b EXCEPT FROM full_a)")
def edges_delta(v):
    return _refresh(v)[1]


@query(("entities",), _BOTH.replace("coalesce(moved.t, family_id)", "family_id") + " SELECT *, 'delete' AS op FROM (FROM cur_a EXCEPT FROM cur_b) UNION ALL SELECT *, 'insert' FROM (FROM cur_b EXCEPT FROM cur_a)")
def newest_delta(v):
    old = tm.latest(inc.known_at(v.entities, SINCE).where("invalid_at is null"))
    return inc.refresh_newest(old, inc.feed(v.entities, SINCE, UNTIL), inc.known_at(v.entities, UNTIL))


# --- traversal at a time ----------------------------------------------------


def _steps_sql(t: str, relations: str, costs: dict[str, int]) -> str:
    cost = "CASE role " + " ".join(f"WHEN '{r}' THEN {c}" for r, c in costs.items()) + " END"
    return f""", every AS (SELECT id, family_id, 'entity' AS role, TIMESTAMP '1990-01-01' AS processed_time, NULL AS e1, NULL AS e2, false AS hid FROM things
UNION ALL SELECT id, family_id, 'relation', processed_time, entity1_id, entity2_id, coalesce(json_extract_string(attributes, '$.tier') = 'candidate' AND json_extract_string(attributes, '$.status') = 'hypothesized', false)
 FROM relations WHERE {relations} AND (valid_at IS NULL OR valid_at <= TIMESTAMP '{t}') AND (invalid_at IS NULL OR invalid_at > TIMESTAMP '{t}')
UNION ALL SELECT id, family_id, 'observation', processed_time, NULL, NULL, false FROM episodes),
stand AS (SELECT *, {cost} AS c FROM (SELECT * FROM every QUALIFY {NEWEST} = 1) WHERE NOT hid),
ends AS (SELECT DISTINCT family_id AS r, x AS e FROM (SELECT family_id, unnest([e1, e2]) AS x FROM stand WHERE role = 'relation') WHERE x IN (SELECT id FROM things)),
told AS (SELECT DISTINCT family_id AS u, target_id AS v FROM stand JOIN mentions ON episode_id = stand.id WHERE role = 'observation' AND target_id IN (SELECT id FROM things)),
near AS (SELECT u, v, c FROM (SELECT r AS u, e AS v FROM ends UNION ALL SELECT e, r FROM ends UNION ALL SELECT u, v FROM told) JOIN stand ON stand.family_id = v)"""


def _reached_sql(starts: str, most: int) -> str:
    return f""", reach(family_id, cost) AS (SELECT family_id, 0 FROM stand WHERE family_id IN ({starts}) UNION SELECT near.v, cost + c FROM reach JOIN near ON near.u = reach.family_id WHERE cost + c <= {most})
SELECT family_id, id, role, min(cost)::INTEGER AS cost FROM reach JOIN stand USING (family_id) GROUP BY ALL"""


@query(("things", "relations", "episodes", "mentions"), _steps_sql(EARLY, f"event_time <= TIMESTAMP '{EARLY}'", {"entity": 1, "relation": 2, "observation": 1}) + _reached_sql("'s1', 's2', 'c1', 'c2', 'c4', 'none'", 9))
def reached_at_a_time(v):
    """Few relations stand at the time, so the recursion visits ways of any length."""
    rows = _concepts(v).where((F.col("role") != "relation") | (F.col("event_time") <= F.lit(EARLY).cast("timestamp")))
    starts = v.spark.createDataFrame([(x,) for x in ("s1", "s2", "c1", "c2", "c4", "none")], "family_id string")
    return tv.traverse(tv.steps(rows, v.mentions, EARLY, {"entity": 1, "relation": 2, "observation": 1}), starts, 9)


@query(("things", "relations", "episodes", "mentions"), _steps_sql(ASOF, "true", {"entity": 1, "relation": 0, "observation": 1}) + _reached_sql("'p1'", 2))
def reached_over_all(v):
    starts = v.spark.createDataFrame([("p1",)], "family_id string")
    return tv.traverse(tv.steps(_concepts(v), v.mentions, ASOF, {"entity": 1, "relation": 0, "observation": 1}), starts, 2)


@query(("things", "relations", "episodes", "mentions"), _steps_sql(EARLY, f"event_time <= TIMESTAMP '{EARLY}'", {"entity": 1, "relation": 1, "observation": 1}) + " SELECT u, v, c::INTEGER AS cost FROM near")
def steps_at_a_time(v):
    rows = _concepts(v).where((F.col("role") != "relation") | (F.col("event_time") <= F.lit(EARLY).cast("timestamp")))
    return tv.steps(rows, v.mentions, EARLY)[1]


# --- names, health, actions -------------------------------------------------

# One name at least for each rule, and valid ones, beside the tables' own.
ODD_NAMES = [
    "", "x", "an entity name that is far longer than a name of this language is", "这是一个非常非常非常非常非常非常非常非常非常非常长的名字没有人会用", "12345", "1984年5月3日", "1984", "处理进度表", "the json file", "my token", "abababab", "玄德曰：善", "according to Ada",
    "Watch out!", "甲、乙", "a, b, c, d", "天下大势，分久必合", "He came. He saw", "北京大学的物理学家", "some_name_here", "张伟（他说，好）", "标题：引言", "how to win", "the best method", "Building a bridge", "曹操病逝", "Research", "研究（topic）",
    "History of Rome", "market analysis", "Ada Lovelace", "李明教授", "JSON（format）", "token ring", "太尉", "C++", "Grace Hopper (admiral)", " padded ", "UPPER", "naïve Bayes",
]


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _broken_sql(n: str) -> str:
    core = _CORE(n)
    texts = {"name": n, "core": core, "long core": f"CASE WHEN length({core}) > 6 THEN {core} ELSE '' END", "notes": f"array_to_string(regexp_extract_all({n}, {_sql_text(nr.NOTE)}, 1), ' ')"}
    cases = []
    for r in nr.RULES:
        x = texts[r.of]
        test = {
            "shorter": lambda x=x, r=r: f"length({x}) < {r.value}",
            "longer": lambda x=x, r=r: f"length({x}) > {r.value}",
            "matches": lambda x=x, r=r: f"regexp_matches({x}, {_sql_text(r.value)})",
            "lacks": lambda x=x, r=r: f"NOT regexp_matches({x}, {_sql_text(r.value)})",
            "among": lambda x=x, r=r: f"lower({x}) IN ({', '.join(map(_sql_text, r.value))})",
            "stutters": lambda x=x: f"len(list_filter(range(1, length({x}) - 4), lambda i: substr({x}, i, 2) = substr({x}, i + 2, 2) AND substr({x}, i, 2) = substr({x}, i + 4, 2))) > 0",
        }[r.kind]()
        latin = "" if r.latin is None else f" AND {'' if r.latin else 'NOT '}regexp_matches({n}, '^[\\x00-\\x7F]*$')"
        cases.append(f"WHEN {test}{latin} THEN '{r.reason}'")
    return f"CASE {' '.join(cases)} END"


_WORDS3 = "array_to_string(string_split(regexp_replace(substr(coalesce(text, ''), 1, 200), '[\\x00-\\x20]+', ' ', 'g'), ' ')[{0}:{1}], ' ')"
_NAMES_ALL = f"""names AS (SELECT DISTINCT {_STRIP('name')} AS name FROM (SELECT name FROM things UNION ALL SELECT c_name FROM customer UNION ALL SELECT n_name FROM nation UNION ALL SELECT p_type || ' of ' || p_name FROM part UNION ALL SELECT p_name || ' ' || o_orderpriority || '、' FROM part, (SELECT DISTINCT o_orderpriority FROM orders)
UNION ALL SELECT {_WORDS3.format(1, 1)} FROM documents UNION ALL SELECT {_WORDS3.format(2, 4)} FROM documents UNION ALL SELECT unnest([{', '.join(map(_sql_text, ODD_NAMES))}])))"""


def _words(start: int, n: int):
    flat = F.split(F.regexp_replace(F.substring(F.coalesce("text", F.lit("")), 1, 200), r"[\x00-\x20]+", " "), " ")
    return F.array_join(F.slice(flat, start, n), " ").alias("name")


@query(("things",), f", {_NAMES_ALL} SELECT name, coalesce({_broken_sql('name')}, 'valid') AS reason FROM names")
def checked_names(v):
    docs, part = v.table("documents"), v.table("part")
    kinds = v.table("orders").select("o_orderpriority").distinct()
    rows = v.things.select("name").unionAll(v.table("customer").select("c_name")).unionAll(v.table("nation").select("n_name")).unionAll(part.select(F.concat_ws(" of ", "p_type", "p_name")))
    rows = rows.unionAll(part.select("p_name").distinct().join(F.broadcast(kinds)).select(F.concat("p_name", F.lit(" "), "o_orderpriority", F.lit("、"))))  # the priorities are a few fixed values
    rows = rows.unionAll(docs.select(_words(1, 1))).unionAll(docs.select(_words(2, 3))).unionAll(v.spark.createDataFrame([(n,) for n in ODD_NAMES], "name string"))
    names = rows.select(strip("name").alias("name")).distinct()
    return names.select("name", F.coalesce(nr.first_broken("name"), F.lit("valid")).alias("reason"))


# Things, customers (every tenth has ended) and documents as entities, a third of the parts with a summary; relations as they are, and one for each document that names no entity.
_UPKEEP = f""", ents AS (SELECT id, family_id, name, content, NULL::TIMESTAMP AS invalid_at, CASE WHEN id LIKE 'p%' AND substr(id, 2)::BIGINT % 3 = 0 THEN 'told' END AS summary FROM things
UNION ALL SELECT 'c' || c_custkey, 'c' || c_custkey, c_name, '', CASE WHEN c_custkey % 10 = 0 THEN TIMESTAMP '{NOW}' END, '' FROM customer UNION ALL SELECT 'd' || doc_id, 'd' || doc_id, {_WORDS3.format(2, 4)}, substr(text, 1, 300), NULL, NULL FROM documents),
rels AS (SELECT id, family_id, entity1_id, entity2_id, content, invalid_at FROM relations UNION ALL SELECT 'w' || doc_id, 'w' || doc_id, 'd' || doc_id, CASE WHEN doc_id % 4 = 0 THEN 'd' || doc_id ELSE 'src:' || coalesce(source, '') END, 'from', NULL FROM documents WHERE doc_id % 2 = 0),
open_e AS (SELECT * FROM ents WHERE invalid_at IS NULL), open_ends AS (SELECT entity1_id AS id FROM rels WHERE invalid_at IS NULL UNION SELECT entity2_id FROM rels WHERE invalid_at IS NULL),
lone AS (SELECT DISTINCT family_id FROM open_e WHERE family_id NOT IN (SELECT family_id FROM ents WHERE id IN (SELECT id FROM open_ends))),
lost AS (SELECT DISTINCT id, e FROM (SELECT id, unnest([entity1_id, entity2_id]) AS e FROM rels) WHERE e NOT IN (SELECT id FROM ents))"""
_BAD = f"(SELECT id, {_broken_sql('name')} AS reason FROM (SELECT id, {_STRIP('name')} AS name FROM open_e))"


def _kept(v):
    told = F.when(F.col("id").startswith("p") & (F.substring("id", 2, 20).cast("long") % 3 == 0), "told")
    things = v.things.select("id", "family_id", "name", "content", F.lit(None).cast("timestamp").alias("invalid_at"), told.alias("summary"))
    c = F.concat(F.lit("c"), "c_custkey")
    ended = F.when(F.col("c_custkey") % 10 == 0, F.lit(NOW).cast("timestamp"))
    customers = v.table("customer").select(c, c, "c_name", F.lit(""), ended, F.lit(""))
    d = F.concat(F.lit("d"), "doc_id")
    docs = v.table("documents")
    entities = things.unionAll(customers).unionAll(docs.select(d, d, _words(2, 3), F.substring("text", 1, 300), F.lit(None).cast("timestamp"), F.lit(None).cast("string")))
    w = F.concat(F.lit("w"), "doc_id")
    end = F.when(F.col("doc_id") % 4 == 0, d).otherwise(F.concat(F.lit("src:"), F.coalesce("source", F.lit(""))))
    relations = v.relations.select("id", "family_id", "entity1_id", "entity2_id", "content", "invalid_at").unionAll(docs.where("doc_id % 2 = 0").select(w, w, d, end, F.lit("from"), F.lit(None).cast("timestamp")))
    return entities, relations


_HEALTH = _UPKEEP + f""", health AS (SELECT (SELECT count(DISTINCT family_id) FROM open_e) AS entities, (SELECT count(*) FROM open_e WHERE coalesce(summary, '') = '') AS unsummarised, (SELECT count(*) FROM {_BAD} WHERE reason IS NOT NULL) AS bad_names,
(SELECT count(DISTINCT family_id) FROM rels WHERE invalid_at IS NULL) AS relations, (SELECT count(*) FROM episodes) AS episodes, (SELECT count(invalid_at) FROM (SELECT invalid_at FROM ents UNION ALL SELECT invalid_at FROM rels)) AS invalid_versions,
(SELECT count(*) FROM lone) AS isolated_entities, (SELECT count(*) FROM lost) AS dangling_ends, (SELECT count(DISTINCT source) FROM documents) AS communities, 0::BIGINT AS cycles)"""


def _health(v):
    labels = v.table("documents").select(F.col("source").alias("community_id"))
    return up.health(*_kept(v), v.episodes, labels)


@query(("things", "relations", "episodes"), _HEALTH + " SELECT * FROM health")
def graph_health(v):
    return _health(v)


# The same row, and one of an empty and one of a sparse graph, so that each rule is kept and broken.
_ROWS3 = "(SELECT 'all' AS graph, * FROM health UNION ALL SELECT 'none', 0, 0, 0, 0, 0, 0, 0, 0, 0, 3 UNION ALL SELECT 'sparse', (SELECT count(*) FROM part), 5, 1, (SELECT count(*) FROM region), 0, 0, 7, 0, 0, 1)"


@query(("things", "relations", "episodes"), _HEALTH + f""" SELECT graph, action, why, priority, count::BIGINT AS count FROM (
{' UNION ALL '.join(f"SELECT graph, '{r.action}' AS action, '{r.why}' AS why, {r.priority} AS priority, {r.count} AS count FROM {_ROWS3} WHERE {r.when}" for r in up.ADVICE)})""")  # fmt: skip
def advised_actions(v):
    row = _health(v)
    sizes = v.table("part").agg(F.count("*").alias("p")).join(F.broadcast(v.table("region").agg(F.count("*").alias("r"))))
    made = [("none", [F.lit(0)] * 9 + [F.lit(3)]), ("sparse", [F.col("p"), F.lit(5), F.lit(1), F.col("r"), F.lit(0), F.lit(0), F.lit(7), F.lit(0), F.lit(0), F.lit(1)])]
    out = None
    for name, rows in [("all", row), *((n, sizes.select(*[x.cast("long").alias(c) for x, c in zip(values, row.columns, strict=True)])) for n, values in made)]:
        part = up.advice(rows).select(F.lit(name).alias("graph"), "action", "why", "priority", "count")
        out = part if out is None else out.unionAll(part)
    return out


@query(("things", "relations"), _UPKEEP + f""" SELECT 'bad_name' AS kind, id AS subject, reason AS detail FROM {_BAD} WHERE reason IS NOT NULL UNION ALL SELECT 'empty_content', id, '' FROM open_e WHERE trim(coalesce(content, '')) = ''
UNION ALL SELECT 'isolated_entity', family_id, '' FROM lone UNION ALL SELECT 'self_relation', id, entity1_id FROM rels WHERE invalid_at IS NULL AND entity1_id = entity2_id UNION ALL SELECT 'dangling_end', id, e FROM lost
UNION ALL SELECT 'shared_core_name', family_id, core FROM (SELECT DISTINCT family_id, lower({_CORE('name')}) AS core FROM open_e WHERE {_CORE('name')} <> '') QUALIFY count(*) OVER (PARTITION BY core) > 1""")  # fmt: skip
def row_findings(v):
    return up.findings(*_kept(v))


@query(("things", "relations"), _UPKEEP + """, r1 AS (SELECT * FROM rels WHERE id NOT IN (SELECT id FROM lost)), ends1 AS (SELECT entity1_id AS id FROM r1 WHERE invalid_at IS NULL UNION SELECT entity2_id FROM r1 WHERE invalid_at IS NULL),
lone1 AS (SELECT DISTINCT family_id FROM open_e WHERE family_id NOT IN (SELECT family_id FROM ents WHERE id IN (SELECT id FROM ends1)))
SELECT 'mend_ends' AS action, 'relations' AS target, id AS subject, 'done' AS status FROM (SELECT DISTINCT id FROM lost) UNION ALL SELECT 'cleanup_isolated', 'entities', id, 'done' FROM ents WHERE family_id IN (SELECT family_id FROM lone1)
UNION ALL SELECT 'cleanup_invalidated', 'entities', id, 'preview' FROM ents WHERE invalid_at IS NOT NULL AND family_id NOT IN (SELECT family_id FROM lone1) UNION ALL SELECT 'cleanup_invalidated', 'relations', id, 'preview' FROM r1 WHERE invalid_at IS NOT NULL""")  # fmt: skip
def action_log(v):
    """Two actions, each twice, then a dry run; the log holds every key once."""
    entities, relations = _kept(v)
    log = v.spark.createDataFrame([], "key string, action string, target string, op string, subject string, status string")
    for action in ("mend_ends", "mend_ends", "cleanup_isolated", "cleanup_isolated"):
        entities, relations, log = up.execute(action, entities, relations, log)
    return up.execute("cleanup_invalidated", entities, relations, log, dry_run=True)[2].select("action", "target", "subject", "status")


# --- alignment with a catalogue, documents by windows -----------------------


def _batch(v):
    """Names that documents tell of, as a batch beside a catalogue of families with some of those names."""
    chunks = windows(v.table("documents"), "doc_id", "text").withColumnRenamed("doc_id", "key")
    entities, relations = capitalised(chunks)
    clean = rs.dedupe_entities(entities.select("name", "content")).select("name", "content")
    none = F.lit(None).cast("array<double>")
    batch = clean.select(F.abs(F.xxhash64("name")).alias("pos"), "name", "content", none.alias("name_vector"), none.alias("full_vector"))
    first = v.table("documents").select(F.concat(F.lit("k"), F.col("doc_id")).alias("family_id"), F.regexp_extract("text", r"^(\p{Lu}[\p{L}\p{N}]{2,})", 1).alias("name"), F.substring("text", 1, 200).alias("content"))
    known = first.where("name <> ''").select("*", none.alias("embedding"))
    return batch, relations, known


@query()
def aligned_documents(v):
    """Matching in order of score has no SQL; a test holds it against a plain loop."""
    return al.align(*_batch(v), NOW)[0].select("family_id", "name", "is_new")


@query()
def aligned_relations(v):
    return al.align(*_batch(v), NOW)[1].select("fam1", "fam2", "content")


_TOLD = """, told AS (SELECT 'c' || o_custkey AS doc, (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) AS win, CASE WHEN o_custkey % 3 > 0 THEN count(*) OVER (PARTITION BY o_custkey) ELSE 99999 END AS total,
CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority || CASE WHEN o_orderkey % 2 = 0 THEN ' (x)' ELSE '' END END AS name, o_orderstatus || ' ' || o_orderpriority AS content FROM orders)"""


@query((), _TOLD + """, s AS (SELECT doc, count(DISTINCT win) AS seen, max(total) AS total FROM told GROUP BY 1), n AS (SELECT doc, lower(trim(regexp_replace(name, '[（(][^）)]+[）)]', '', 'g'))) AS core, min(name) AS name, arg_max(content, (length(content), content)) AS content, count(DISTINCT win)::INTEGER AS windows FROM told WHERE name IS NOT NULL GROUP BY 1, 2)
SELECT doc, core, name, content, windows, CASE WHEN seen >= total THEN 'complete' ELSE 'expired' END AS closed FROM n JOIN s USING (doc)""")  # fmt: skip
def documents_by_windows(v):
    """The batch answer that the streaming state must reach; a test replays and restarts the stream."""
    o, by = v.table("orders"), Window.partitionBy("o_custkey")
    name = F.when(F.col("o_orderstatus") != "P", F.concat("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, " (x)").otherwise("")))
    rows = o.select(
        F.concat(F.lit("c"), "o_custkey").alias("doc"), (F.row_number().over(by.orderBy("o_orderkey")) - 1).alias("window"), F.when(F.col("o_custkey") % 3 > 0, F.count("*").over(by)).otherwise(99999).alias("total"),
        name.alias("name"), F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("content"), F.col("o_orderdate").alias("at"),
    )
    return dc.merged_batch(rows)


# --- unified find -----------------------------------------------------------

_HITS0 = ", evec AS (SELECT 'p' || e.vec_id AS family_id, " + _COS("e.embedding", "q.embedding") + " AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY score DESC, family_id LIMIT 40)"
_FUSED = "f AS (SELECT family_id, sum(w) AS w FROM ({0}) GROUP BY 1)"
ORACLES["hybrid_search"] = (
    sql("things") + bm25_sql("things", "family_id", "content", ["red", "widget"], 40, "hits") + _HITS0 + ", " + _FUSED.format(rank_sql("hits", 0.3) + " UNION ALL " + rank_sql("evec", 0.7))
    + " SELECT family_id, round(w / (SELECT max(w) FROM f), 4) AS score FROM f ORDER BY score DESC, family_id LIMIT 20"
)
ORACLES["find_by_name"] = (
    sql("things") + bm25_sql("things", "family_id", "name", ["red", "widget"], 20, "hits")
    + f""", ways AS (SELECT family_id, CASE WHEN name = 'Red Widget' THEN 0 WHEN lower({_CORE('name')}) = 'red widget' THEN 1 WHEN starts_with(lower(name), 'red widget') THEN 2 END AS kind, 1.0::DOUBLE AS score FROM things),
every AS (SELECT * FROM ways WHERE kind IS NOT NULL UNION ALL SELECT family_id, 3, score FROM hits) SELECT family_id, kind, score FROM every WHERE kind = (SELECT min(kind) FROM every) ORDER BY score DESC, family_id LIMIT 20"""
)


def _found_sql(query: str, words: list[str], entity_arms: str, until: str | None) -> str:
    """All stages over things and the newest visible relations."""
    named = f"({_CORE('name')} = '{query}' OR name = '{query}' OR starts_with(name, '{query}（') OR starts_with(name, '{query}('))"
    when = f" WHERE event_time IS NULL OR event_time <= TIMESTAMP '{until}'" if until else ""
    return (
        _NOW_REL + bm25_sql("things", "family_id", "content", words, 40, "hits") + bm25_sql("nowrel", "family_id", "content", words, 100, "rhits") + _HITS0
        + ", " + _FUSED.format(rank_sql("hits", 0.3) + entity_arms)
        + f""", eh AS (SELECT family_id, round(w / (SELECT max(w) FROM f), 4) AS score FROM f ORDER BY score DESC, family_id LIMIT 20),
rf AS ({rank_sql('rhits', 0.3)}), rh AS (SELECT family_id, round(w / (SELECT max(w) FROM rf), 4) AS score FROM rf ORDER BY score DESC, family_id LIMIT 50),
pre AS (SELECT family_id FROM things WHERE starts_with(name, '{query}') AND family_id NOT IN (SELECT family_id FROM eh) ORDER BY family_id LIMIT 3),
e1 AS (SELECT * FROM eh UNION ALL SELECT family_id, 0.0 FROM pre WHERE EXISTS (SELECT 1 FROM eh JOIN things USING (family_id)) AND NOT EXISTS (SELECT 1 FROM eh JOIN things USING (family_id) WHERE {named})),
ends AS (SELECT DISTINCT relation, x AS family_id FROM (SELECT family_id AS relation, unnest([entity1_id, entity2_id]) AS x FROM nowrel) WHERE x IN (SELECT id FROM things)),
e2 AS (SELECT * FROM e1 UNION ALL SELECT ends.family_id, max(rh.score) * 0.5 FROM rh JOIN ends ON relation = rh.family_id WHERE ends.family_id NOT IN (SELECT family_id FROM e1) GROUP BY 1),
near AS (SELECT relation, max(e2.score) * 0.3 AS score FROM ends JOIN e2 USING (family_id) GROUP BY 1),
wide AS (SELECT relation AS family_id, score FROM (SELECT near.*, processed_time, id FROM near JOIN nowrel ON nowrel.family_id = relation ORDER BY processed_time DESC, id DESC LIMIT 50) WHERE relation NOT IN (SELECT family_id FROM rh)),
e3 AS (SELECT * FROM e2 UNION ALL SELECT DISTINCT ends.family_id, 0.0 FROM wide JOIN ends ON relation = wide.family_id WHERE ends.family_id NOT IN (SELECT family_id FROM e2)),
r3 AS (SELECT * FROM rh UNION ALL SELECT * FROM wide),
ee AS (SELECT family_id, name, TIMESTAMP '{MID}' AS event_time, 0.8::DOUBLE AS confidence, score AS s FROM e3 JOIN things USING (family_id)),
es AS (SELECT family_id, name, round(s * {_AGED}, 6) AS score FROM ee{when} ORDER BY score DESC, family_id LIMIT 20),
rr AS (SELECT family_id, content, event_time, confidence, r3.score AS s FROM r3 JOIN nowrel USING (family_id)),
rs AS (SELECT family_id, content, round(s * {_AGED}, 6) AS score FROM rr{when} ORDER BY score DESC, family_id LIMIT 50),
rd AS (SELECT * FROM rs QUALIFY trim(substr(coalesce(content, ''), 1, 60)) = '' OR row_number() OVER (PARTITION BY trim(substr(coalesce(content, ''), 1, 60)) ORDER BY score DESC, family_id) = 1)
SELECT 'entity' AS kind, family_id, score, row_number() OVER (ORDER BY CASE WHEN {named} THEN 0 ELSE 1 END, score DESC, family_id)::INTEGER AS place FROM es
UNION ALL SELECT 'relation', family_id, score, row_number() OVER (ORDER BY score DESC, family_id)::INTEGER FROM rd"""
    )


def _dated(v):
    return v.things.withColumn("event_time", F.lit(MID).cast("timestamp")).withColumn("confidence", F.lit(0.8))


@query(("things", "relations"), _found_sql("red widget", ["red", "widget", "r", "36"], " UNION ALL " + rank_sql("evec", 0.7), None).replace("'red widget", "'red widget r 36"))
def found_with_relations(v):
    """A query that hits things by text and vectors and relations by text."""
    vec = v.table("embeddings")
    near = vec.join(F.broadcast(vec.where("vec_id = 0").select(F.col("embedding").alias("q")))).select(F.concat(F.lit("p"), "vec_id").alias("family_id"), F.round(tx.cosine("embedding", "q"), 6).alias("score"))
    return uf.find(_dated(v), v.relations, "red widget r 36", NOW, entity_hits=near.orderBy(F.desc("score"), "family_id").limit(40))


@query(("things", "relations"), _found_sql("small", ["small"], "", "1998-06-01 00:00:00").replace(f"TIMESTAMP '{MID}' AS event_time", "NULL::TIMESTAMP AS event_time").replace("epoch_us(event_time)", f"epoch_us(coalesce(event_time, TIMESTAMP '{NOW}'))"))
def found_before(v):
    """A short query that begins names, up to a time; things have no event and aren't aged."""
    return uf.find(_dated(v).withColumn("event_time", F.lit(None).cast("timestamp")), v.relations, "small", NOW, until="1998-06-01 00:00:00")
