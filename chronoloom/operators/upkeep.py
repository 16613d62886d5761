"""A graph's health, rules that turn it into advice, findings on rows, and actions that can be repeated.

Rules are a table: an action, the condition under which it is advised and its
priority, all over one row of statistics.  An action is planned as rows (table,
operation, subject); each planned row has a key, and a log of the keys carried
out makes a repeated or resumed run do the rest only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.functions.name_rules import first_broken
from chronoloom.functions.names import summary
from chronoloom.functions.text import core_name
from chronoloom.operators.relations import dangling
from chronoloom.plans.materialize import materialize


@dataclass(frozen=True)
class Advice:
    """``when`` and ``priority`` are SQL over the row of ``health``; ``count`` says how many rows are concerned."""

    action: str
    why: str
    when: str
    priority: str
    count: str


ADVICE = (
    Advice("cleanup_isolated", "entities without relations", "isolated_entities > 0", "CASE WHEN isolated_entities > 20 THEN 'high' ELSE 'medium' END", "isolated_entities"),
    Advice("cleanup_invalidated", "versions that have ended", "invalid_versions > 0", "'medium'", "invalid_versions"),
    Advice("run_dream", "few relations for the entities", "entities > 0 AND 10 * relations < 3 * entities", "'high'", "relations"),
    Advice("run_dream", "no cycle has run", "cycles = 0", "'medium'", "cycles"),
    Advice("detect_communities", "no community is labelled", "communities = 0 AND entities > 20", "'low'", "entities"),
    Advice("evolve_summaries", "most entities have no summary", "2 * unsummarised > entities", "'low'", "unsummarised"),
    Advice("mend_names", "names that break a rule", "bad_names > 0", "CASE WHEN 10 * bad_names > entities THEN 'high' ELSE 'low' END", "bad_names"),
    Advice("mend_ends", "relations with an end that is no entity", "dangling_ends > 0", "'high'", "dangling_ends"),
)


#: Tables that an action changes.
TARGETS = {"cleanup_isolated": ("entities",), "cleanup_invalidated": ("entities", "relations"), "evolve_summaries": ("entities",), "mend_ends": ("relations",)}


def _open(rows: DataFrame) -> DataFrame:
    return rows.where("invalid_at is null")


def _isolated(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Families none of whose versions is an end of an open relation."""
    ends = _open(relations).select(F.explode(F.array("entity1_id", "entity2_id")).alias("id")).distinct()
    linked = entities.select("id", "family_id").join(ends, "id", "left_semi").select("family_id").distinct()
    return _open(entities).select("family_id").distinct().join(linked, "family_id", "left_anti")


def health(entities: DataFrame, relations: DataFrame, episodes: DataFrame, labels: DataFrame | None = None, logs: DataFrame | None = None) -> DataFrame:
    """One row of counts; entities may have a ``summary``, ``labels`` a ``community_id``."""
    unsummarised = F.count_if(F.trim(F.coalesce("summary", F.lit(""))) == "") if "summary" in entities.columns else F.count("*")
    now = _open(entities)
    parts = [
        now.agg(F.countDistinct("family_id").alias("entities"), unsummarised.alias("unsummarised"), F.count_if(first_broken("name").isNotNull()).alias("bad_names")),
        _open(relations).agg(F.countDistinct("family_id").alias("relations")),
        episodes.agg(F.count("*").alias("episodes")),
        entities.select("invalid_at").unionAll(relations.select("invalid_at")).agg(F.count("invalid_at").alias("invalid_versions")),
        _isolated(entities, relations).agg(F.count("*").alias("isolated_entities")),
        dangling(relations, entities).agg(F.count("*").alias("dangling_ends")),
    ]
    for rows, name, of in ((labels, "communities", "community_id"), (logs, "cycles", "cycle_id")):
        if rows is not None:
            parts.append(rows.agg(F.countDistinct(of).alias(name)))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(F.broadcast(part))  # one row each
    for name in ("communities", "cycles"):
        if name not in out.columns:
            out = out.withColumn(name, F.lit(0).cast("long"))
    return out


def advice(health_row: DataFrame, rules: tuple[Advice, ...] = ADVICE) -> DataFrame:
    """Advised actions in order of priority: ``place``, ``action``, ``priority``, ``why``, ``count``."""
    each = [F.struct(F.lit(i).alias("rule"), F.lit(r.action).alias("action"), F.when(F.expr(r.when), F.expr(r.priority)).alias("priority"), F.lit(r.why).alias("why"), F.expr(f"cast({r.count} AS long)").alias("count")) for i, r in enumerate(rules)]
    weight = F.when(F.col("priority") == "high", 0).when(F.col("priority") == "medium", 1).otherwise(2)
    return health_row.select(F.explode(F.array(*each)).alias("r")).select("r.*").where("priority is not null").withColumn("weight", weight).orderBy("weight", "rule").drop("weight")


def findings(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Rows that break a rule: ``kind``, ``subject``, ``detail``; an entity row may have several."""
    now, links = _open(entities), _open(relations)
    broken = now.withColumn("reason", first_broken("name")).where("reason is not null").select(F.lit("bad_name").alias("kind"), F.col("id").alias("subject"), F.col("reason").alias("detail"))
    bare = now.where(F.trim(F.coalesce("content", F.lit(""))) == "").select(F.lit("empty_content"), "id", F.lit(""))
    lone = _isolated(entities, relations).select(F.lit("isolated_entity"), "family_id", F.lit(""))
    selves = links.where("entity1_id = entity2_id").select(F.lit("self_relation"), "id", "entity1_id")
    lost = dangling(relations, entities).select(F.lit("dangling_end"), "relation_id", "entity_id")
    cores = now.select(F.lower(core_name("name")).alias("core"), "family_id").where("core <> ''").distinct()
    twice = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1")
    same = cores.join(twice.select("core"), "core").select(F.lit("shared_core_name"), "family_id", "core")
    out = broken
    for part in (bare, lone, selves, lost, same):
        out = out.unionAll(part)
    return out


def planned(action: str, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """What an action would do: ``key``, ``action``, ``target``, ``op``, ``subject`` and a ``value`` where it writes one."""
    if action == "cleanup_isolated":
        rows = entities.join(_isolated(entities, relations), "family_id", "left_semi").select(F.lit("entities").alias("target"), F.lit("delete").alias("op"), F.col("id").alias("subject"), F.lit(None).cast("string").alias("value"))
    elif action == "cleanup_invalidated":
        ended = lambda df, name: df.where("invalid_at is not null").select(F.lit(name).alias("target"), F.lit("delete").alias("op"), F.col("id").alias("subject"), F.lit(None).cast("string").alias("value"))
        rows = ended(entities, "entities").unionAll(ended(relations, "relations"))
    elif action == "evolve_summaries":
        bare = _open(entities) if "summary" not in entities.columns else _open(entities).where(F.trim(F.coalesce("summary", F.lit(""))) == "")
        rows = bare.select(F.lit("entities").alias("target"), F.lit("set_summary").alias("op"), F.col("id").alias("subject"), summary("name", "content").alias("value"))
    elif action == "mend_ends":
        rows = dangling(relations, entities).select(F.lit("relations").alias("target"), F.lit("delete").alias("op"), F.col("relation_id").alias("subject"), F.lit(None).cast("string").alias("value")).distinct()
    else:
        raise ValueError(f"unknown action: {action}")
    key = F.md5(F.concat_ws("|", F.lit(action), "target", "op", "subject").cast("binary"))
    return rows.select(key.alias("key"), F.lit(action).alias("action"), "target", "op", "subject", "value")


def execute(action: str, entities: DataFrame, relations: DataFrame, log: DataFrame, dry_run: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations after an action, and the log (``key``, ``action``, ``target``, ``op``, ``subject``, ``status``).

    Planned rows whose key the log has as done are left out, so a replay changes
    nothing; a dry run changes nothing and logs previews.  What is to be done is
    written, not the tables after it; a table that the action leaves alone is
    returned as it came.
    """
    todo = planned(action, entities, relations).join(log.where("status = 'done'").select("key"), "key", "left_anti")
    status = F.lit("preview" if dry_run else "done")
    written = log.unionByName(todo.select("key", "action", "target", "op", "subject", status.alias("status")))
    if dry_run:
        return entities, relations, written
    todo = materialize(todo, "todo")
    written = log.unionByName(todo.select("key", "action", "target", "op", "subject", status.alias("status")))
    out = []
    for rows, name in ((entities, "entities"), (relations, "relations")):
        if name not in TARGETS[action]:
            out.append(rows)
            continue
        mine = todo.where(F.col("target") == name)
        rows = rows.join(mine.where("op = 'delete'").select(F.col("subject").alias("id")), "id", "left_anti")
        if name == "entities" and action == "evolve_summaries":
            new = mine.where("op = 'set_summary'").select(F.col("subject").alias("id"), F.col("value").alias("_new"))
            had = F.col("summary") if "summary" in rows.columns else F.lit(None).cast("string")
            rows = rows.join(new, "id", "left").withColumn("summary", F.coalesce("_new", had)).drop("_new")
        out.append(rows)
    return out[0], out[1], written
