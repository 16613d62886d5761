"""Validators that give what they keep and what they reject, with reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.names import clean_name, grounded, viable_name
from chronoloom.functions.text import core_name, strip

# Words of the engine's own that a content shouldn't hold.
LEAKS = ["处理进度", "步骤", "缓存", "抽取", "token", "api"]
LEAST_ENTITY, LEAST_RELATION = 10, 8
#: Longest array that repeats a row.
STRETCH = 10_000


def _mention(name):
    return F.concat(F.lit("文本中提到了“"), name, F.lit("”这一概念。"))


def stabilised(rows: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """One row for each core name, and a row with a reason for every other.

    A group keeps its longest name and its longest content, the first of equals.
    """
    named = rows.select(F.col(order).alias("pos"), strip(F.coalesce("name", F.lit(""))).alias("name"), strip(F.coalesce("content", F.lit(""))).alias("content"))
    named = named.withColumn("cleaned", clean_name("name")).withColumn("core", core_name("cleaned"))
    good = named.where(viable_name("cleaned"))
    best = good.groupBy("core").agg(
        F.max_by("cleaned", F.struct(F.length("cleaned"), -F.col("pos"))).alias("name"), F.max_by("content", F.struct(F.length("content"), -F.col("pos"))).alias("content"), F.min("pos").alias("pos")
    )
    by = Window.partitionBy("core").orderBy("pos")
    first = F.row_number().over(Window.partitionBy("core", "cleaned").orderBy("pos")) == 1
    longest = F.max(F.length("content")).over(by.rowsBetween(Window.unboundedPreceding, -1))
    judged = good.withColumn("place", F.row_number().over(by)).withColumn("first", first).withColumn("longest", longest)
    reason = F.when(F.col("first"), "duplicate_core_name").when(F.length("content") > F.col("longest"), "duplicate_name_replaced_shorter_content").otherwise("duplicate_name")
    again = judged.where("place > 1").select("pos", "name", reason.alias("reason"))
    bad = named.where(~viable_name("cleaned")).select("pos", "name", F.lit("invalid_name").alias("reason"))
    return best.select("pos", "name", "content"), bad.unionAll(again)


def written(rows: DataFrame, stable: DataFrame, fallback: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """A content for each stable ``name``: the longest written one, else its fallback, else a plain mention; and what was odd.

    ``stable`` and ``fallback`` hold each name once.
    """
    own = rows.select(F.col(order).alias("pos"), clean_name("name").alias("name"), strip(F.coalesce("content", F.lit(""))).alias("written"))
    spare = fallback.select("name", strip(F.coalesce("content", F.lit(""))).alias("spare"))
    known = own.join(stable.select("name", F.lit(True).alias("known")), "name", "left").join(spare, "name", "left")
    plain = _mention(F.col("name"))
    known = known.withColumn("content", F.coalesce(F.nullif("written", F.lit("")), F.nullif("spare", F.lit("")), plain))
    lost = F.when(F.col("name") == "", "missing_name").when(F.col("known").isNull(), "unknown_stable_name")
    good = known.where(lost.isNull())
    place = F.row_number().over(Window.partitionBy("name").orderBy("pos"))
    longest = F.max(F.length("content")).over(Window.partitionBy("name").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    again = good.withColumn("place", place).withColumn("longest", longest).where("place > 1")
    again = again.select("name", F.when(F.length("content") > F.col("longest"), "duplicate_name_replaced_shorter_content").otherwise("duplicate_name").alias("reason"))
    empty = good.where((F.col("written") == "") & (F.coalesce("spare", F.lit("")) == "")).select("name", F.lit("empty_content_fallback").alias("reason"))
    best = good.groupBy("name").agg(F.max_by("content", F.struct(F.length("content"), -F.col("pos"))).alias("content"))
    out = stable.select("name").join(best, "name", "left").join(spare, "name", "left")
    missing = out.where("content is null").select("name", F.lit("missing_written_entity_fallback").alias("reason"))
    report = known.where(lost.isNotNull()).select("name", lost.alias("reason")).unionAll(empty).unionAll(again).unionAll(missing)
    return out.select("name", F.coalesce("content", F.nullif("spare", F.lit("")), plain).alias("content")), report


def consistent(rows: DataFrame, relations: DataFrame, source: str = "source") -> DataFrame:
    """Entities that their texts mention, or that are an end (``name1``, ``name2``) of a relation."""
    ends = relations.select(F.explode(F.array("name1", "name2")).alias("name")).distinct()
    marked = rows.join(ends.withColumn("end", F.lit(True)), "name", "left")
    return marked.where(F.col("end").isNotNull() | grounded("name", "content", source)).drop("end")


def verified(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Findings on a window's results: ``kind``, ``subject``, ``detail``, one row each."""
    ends = relations.select(F.explode(F.array("entity1_id", "entity2_id")).alias("family_id")).distinct()
    lone = entities.join(ends, "family_id", "left_anti").select(F.lit("isolated_entities").alias("kind"), F.col("family_id").alias("subject"), F.col("name").alias("detail"))
    body = F.coalesce("content", F.lit(""))
    short = entities.where(F.length(body) < LEAST_ENTITY).select(F.lit("entity_content_too_short"), "family_id", "name")
    held = F.filter(F.array(*[F.lit(w) for w in LEAKS]), lambda w: F.contains(F.lower(body), w))
    leak = entities.withColumn("_w", F.get(held, 0)).where("_w is not null").select(F.lit("entity_content_system_leak"), "family_id", "_w")
    thin = relations.where(F.length(body) < LEAST_RELATION).select(F.lit("relation_content_too_short"), "family_id", body)
    cores = entities.select(core_name("name").alias("core"), "family_id").distinct()
    twice = cores.groupBy("core").agg(F.count("*").alias("n")).where("n > 1").select("core")
    same = cores.join(twice, "core").select(F.lit("duplicate_core_names"), "family_id", "core")
    invalid = entities.where((F.coalesce("name", F.lit("")) != "") & ~viable_name("name")).select(F.lit("invalid_entity_name"), "family_id", "name")
    return lone.unionAll(short).unionAll(leak).unionAll(thin).unionAll(same).unionAll(invalid)


def new_candidates(pairs: DataFrame, names: DataFrame, related: DataFrame) -> DataFrame:
    """Candidate pairs (``left_name``, ``right_name``) but for two names of this window that are related already."""
    a, b = F.least("left_name", "right_name").alias("a"), F.greatest("left_name", "right_name").alias("b")
    known = related.select(F.least("name1", "name2").alias("a"), F.greatest("name1", "name2").alias("b")).where("a <> b").distinct()
    here = known.join(names.select(F.col("name").alias("a")).distinct(), "a", "left_semi").join(names.select(F.col("name").alias("b")).distinct(), "b", "left_semi")
    return pairs.withColumns({"_a": a, "_b": b}).join(here.select(F.col("a").alias("_a"), F.col("b").alias("_b")), ["_a", "_b"], "left_anti").drop("_a", "_b")


def pair_counts(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """The pairs ``left_name``, ``right_name`` of an equi-join, each once with its number ``n``; a side of many equal names makes few rows."""
    a, b = (df.groupBy(on, name).agg(F.count("*").alias(n)) for df, name, n in ((left, "left_name", "_l"), (right, "right_name", "_r")))
    return a.join(b, on).select("left_name", "right_name", (F.col("_l") * F.col("_r")).alias("n"))


def repeated(rows: DataFrame, n: str = "n") -> DataFrame:
    """Every row as often as its ``n`` says; stretches keep the arrays short."""
    stretches = rows.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / STRETCH))))
    inside = F.sequence(F.lit(1).cast("long"), F.least(F.lit(STRETCH), F.col(n) - F.col("_s") * STRETCH))
    return stretches.withColumn("_i", F.explode(inside)).drop("_s", "_i", n)


def best_of_join(left: DataFrame, right: DataFrame, on: str) -> DataFrame:
    """``best_match`` of the pairs of an equi-join, without making them: ``left`` has ``left_name`` and ``score``, ``right`` has ``right_name`` and ``place``.

    Of equal left names with one key the best score counts, and of the right
    rows of a key the one that is first among equal scores.
    """
    a = left.where(F.col(on).isNotNull()).groupBy(on, "left_name").agg(F.max("score").alias("score"))
    b = right.where(F.col(on).isNotNull()).groupBy(on).agg(F.max(F.struct(*_standing())).alias("_b")).select(on, "_b.place", "_b.right_name")
    return a.join(b, on).select("left_name", "right_name", "score", "place")


def _standing() -> list[Column]:
    """What decides among equal scores."""
    return [F.col("right_name").rlike(r"[（(][^）)]+[）)]").cast("int").alias("noted"), F.col("place"), F.length("right_name").alias("size"), F.col("right_name")]


def best_match(scored: DataFrame) -> DataFrame:
    """The best-scored known name (``right_name``, ``place``) of each left one: of equals the bracketed, the later, the longer, the larger."""
    return scored.groupBy("left_name").agg(F.max_by("right_name", F.struct("score", *_standing())).alias("right_name"), F.max("score").alias("score"))


def chunks(rows: DataFrame, size: int, order: str, *group: str) -> DataFrame:
    """Numbers chunks of ``size`` rows in each group."""
    return rows.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(*group).orderBy(order)) - 1) / size))


def resumed(documents: DataFrame, path: str, order: str = "pos") -> DataFrame:
    """Documents from the one at ``path`` on, in order; all of them where it isn't among them."""
    at = documents.where(F.col("path") == path).agg(F.min(order).alias("_at"))
    return documents.join(F.broadcast(at)).where(F.col("_at").isNull() | (F.col(order) >= F.col("_at"))).drop("_at").orderBy(order)
