"""Entity resolution: clean-up of extractions, blocked candidates, decisions, merges across windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.functions.text import characters, core_name, cosine, jaccard, leading_name
from chronoloom.operators import search as se
from chronoloom.operators import vectors as vx
from chronoloom.operators.components import connected_components
from chronoloom.operators.simjoin import name_pairs, overlap_join
from chronoloom.plans.materialize import materialize

# Scores and bounds of name matches and decisions.
EXACT_CORE, SUBSTRING_BASE, SUBSTRING_SPAN, SUBSTRING_CAP = 0.85, 0.65, 0.30, 0.95
SAME_VERSION, NEW_ENTITY, MERGE_ACROSS = 0.85, 0.4, 0.75


def valid_name() -> Column:
    """2 to 60 characters, not only digits or signs."""
    n = F.trim("name")
    return F.length(n).between(2, 60) & ~n.rlike(r"^[\d\s.,:%+\-/]+$") & n.rlike(r"[\p{L}]")


def valid_content(least: int = 15) -> Column:
    return F.length(F.trim(F.coalesce("content", F.lit("")))) >= least


def dedupe_entities(rows: DataFrame, least: int = 8) -> DataFrame:
    """One row for each core name: the longest content, then the name."""
    ok = rows.where(valid_name() & valid_content(least))
    return ok.groupBy(core_name("name").alias("core")).agg(F.max_by(F.struct("name", "content"), F.struct(F.length("content"), "name", "content")).alias("b")).select("core", "b.name", "b.content")


def dedupe_names(rows: DataFrame) -> DataFrame:
    """One name for each core name; the first annotated variant replaces a plain one (``pos`` gives the order)."""
    ok = rows.where(valid_name()).withColumn("core", leading_name("name"))
    return ok.groupBy("core").agg(F.min_by("name", F.struct(~F.col("name").rlike("[（(]"), "pos")).alias("name"))


def normalize_pairs(relations: DataFrame) -> DataFrame:
    """Trimmed ends in order, without self links and blank ends."""
    a, b = F.trim(F.coalesce("name1", F.lit(""))), F.trim(F.coalesce("name2", F.lit("")))
    return relations.withColumns({"name1": F.least(a, b), "name2": F.greatest(a, b)}).where((F.col("name1") != F.col("name2")) & (F.col("name1") != ""))


def dedupe_relations(relations: DataFrame) -> DataFrame:
    """One row for each pair and content (case-folded)."""
    rows = normalize_pairs(relations)
    return rows.groupBy("name1", "name2", F.substring(F.md5(F.lower(F.trim("content")).cast("binary")), 1, 12).alias("content_hash")).agg(F.min("content").alias("content"))


def longest_hint(relations: DataFrame) -> DataFrame:
    """Of each pair the longest content."""
    rows = normalize_pairs(relations)
    return rows.groupBy("name1", "name2").agg(F.max_by("content", F.struct(F.length("content"), "content")).alias("content"))


def merge_contents(relations: DataFrame, most: int = 3) -> DataFrame:
    """Of each pair the first distinct contents, joined."""
    rows = normalize_pairs(relations)
    firsts = rows.groupBy("name1", "name2", "content").agg(F.min("pos").alias("pos"))
    by = Window.partitionBy("name1", "name2").orderBy("pos", "content")
    kept = firsts.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= most)
    return kept.groupBy("name1", "name2").agg(F.concat_ws("；", F.transform(F.array_sort(F.collect_list(F.struct("rank", "content"))), lambda x: x["content"])).alias("content"))


def resolve_ends(relations: DataFrame, names: DataFrame) -> DataFrame:
    """Ends to known names: exact, case-folded, then a core name that is unique; unresolved rows keep a reason."""
    known = names.select("name").distinct()
    exact = known.select(F.col("name").alias("key"), "name", F.lit(0).alias("kind"))
    folded = known.groupBy(F.lower("name").alias("key")).agg(F.min("name").alias("name")).select(F.concat(F.lit("\u0001"), "key").alias("key"), "name", F.lit(1).alias("kind"))
    cores = known.groupBy(F.lower(leading_name("name")).alias("key")).agg(F.min("name").alias("name"), F.count("*").alias("n")).where("n = 1")
    every = exact.unionAll(folded).unionAll(cores.select(F.concat(F.lit("\u0002"), "key").alias("key"), "name", F.lit(2).alias("kind")))
    out = relations.withColumn("_row", F.monotonically_increasing_id()) if "rel_id" not in relations.columns else relations.withColumn("_row", F.col("rel_id"))
    for side in ("name1", "name2"):
        raw = F.trim(side)
        keys = F.array(raw, F.concat(F.lit("\u0001"), F.lower(raw)), F.concat(F.lit("\u0002"), F.lower(leading_name(raw))))
        hits = out.select("_row", F.explode(keys).alias("key")).join(every, "key").groupBy("_row").agg(F.min_by("name", "kind").alias(f"_{side}"))
        out = out.join(hits, "_row", "left")
    reason = F.when(F.col("_name1").isNull() | F.col("_name2").isNull(), "unknown_end").when(F.col("_name1") == F.col("_name2"), "self_link")
    return out.withColumn("reason", reason).withColumn("name1", F.coalesce("_name1", "name1")).withColumn("name2", F.coalesce("_name2", "name2")).drop("_row", "_name1", "_name2")


def name_score(left: Column, right: Column) -> Column:
    """Jaccard of names, lifted by an equal core name or by one core name holding the other."""
    a, b = F.lower(core_name(left)), F.lower(core_name(right))
    inside = (a != "") & (b != "") & (a.contains(b) | b.contains(a))
    ratio = F.least(F.length(a), F.length(b)) / F.greatest(F.length(a), F.length(b))
    lifted = F.when(a == b, F.lit(EXACT_CORE)).when(inside, F.least(F.lit(SUBSTRING_BASE) + SUBSTRING_SPAN * ratio, F.lit(SUBSTRING_CAP))).otherwise(0.0)
    return F.when(left == right, F.lit(1.0)).otherwise(F.greatest(jaccard(left, right), lifted))


def candidate_table(extracted: DataFrame, known: DataFrame, threshold: float = 0.6, top: int = 5) -> DataFrame:
    """Best known names for each extracted one, by score then name."""
    score = F.round(name_score(F.col("left_name"), F.col("right_name")), 6)
    pairs = name_pairs(extracted, known, threshold, top, exact_core=EXACT_CORE, base=SUBSTRING_BASE, span=SUBSTRING_SPAN)
    scored = pairs.distinct().withColumn("score", score).where(F.col("score") >= threshold)
    by = Window.partitionBy("left_name").orderBy(F.desc("score"), "right_name")
    return scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def entity_candidates(extracted: DataFrame, known: DataFrame, lexical: float = 0.6, dense: float = 0.6, top: int = 10, safe_lexical: float = 0.5, safe_dense: float = 0.85) -> DataFrame:
    """Known families for each extracted row, by names and by vectors: ``pos``, ``family_id``, the scores, ``merge_safe`` and ``rank``.

    ``extracted`` has ``pos``, ``name``, ``name_vector`` and ``full_vector``;
    ``known`` has one row for each family with ``name`` and ``embedding``.  A pair
    comes in by its name score or by either cosine; all three are then computed
    for it, and the largest counts.  Merging is safe for equal core names, or if
    both the names and a vector are close enough.

    A family's score is its name's score, or a cosine that is larger, so the best
    ``top`` by names and the best by each vector hold the best of all, and only
    those meet vectors.  That needs every cosine above a name score that counts:
    where ``dense`` is more than ``lexical``, all pairs by names go on.
    """
    mine = materialize(extracted.select("pos", "name", "name_vector", "full_vector"), "extracted")
    rows = materialize(known.select("family_id", F.col("name").alias("known_name"), "embedding"), "known")
    most = top if dense <= lexical else None
    score = F.round(name_score(F.col("left_name"), F.col("right_name")), 6)
    named = rows.select(F.col("known_name").alias("name"), "family_id")
    alike = name_pairs(mine.select("name"), named, lexical, most, exact_core=EXACT_CORE, base=SUBSTRING_BASE, span=SUBSTRING_SPAN, rank="family_id")
    alike = materialize(alike.distinct().withColumn("score", score).where(F.col("score") >= lexical), "alike-names")

    def first(found: DataFrame, key: str, *order: Column | str) -> DataFrame:
        if most is None:
            return found
        return found.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order, "family_id"))).where(F.col("_r") <= most).drop("_r")

    families = alike.join(first(named, "name"), F.col("name") == F.col("right_name")).select("left_name", "family_id", "score")
    pairs = mine.select("pos", F.col("name").alias("left_name")).join(first(families, "left_name", F.desc("score")), "left_name").select("pos", "family_id", "score", F.col("score").alias("_lexical"))
    for column in ("name_vector", "full_vector"):
        pairs = pairs.unionAll(vx.nearest(mine, rows, "pos", "family_id", most, dense, query_column=column).withColumn("_lexical", F.lit(None).cast("double")))
    pairs = first(pairs.groupBy("pos", "family_id").agg(F.max("score").alias("_score"), F.max("_lexical").alias("_lexical")), "pos", F.desc("_score")).select("pos", "family_id", "_lexical")
    met = pairs.join(mine, "pos").join(rows, "family_id")
    scored = met.withColumn("lexical_score", F.coalesce("_lexical", F.round(name_score(F.col("name"), F.col("known_name")), 6))).withColumn(
        "dense_score", F.round(F.greatest(cosine("name_vector", "embedding"), cosine("full_vector", "embedding")), 6)
    )
    same = (F.lower(core_name("name")) == F.lower(core_name("known_name"))) & (core_name("name") != "")
    scored = scored.withColumn("score", F.greatest("lexical_score", "dense_score")).withColumn("merge_safe", same | ((F.col("dense_score") >= safe_dense) & (F.col("lexical_score") >= safe_lexical)))
    by = Window.partitionBy("pos").orderBy(F.desc("score"), "family_id")
    ranked = scored.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)
    return ranked.select("pos", "family_id", "lexical_score", "dense_score", "score", "merge_safe", "rank")


def with_text_hits(candidates: DataFrame, extracted: DataFrame, known: DataFrame, lexical: float = 0.6, hits: int = 5, top: int = 10) -> DataFrame:
    """Candidates with those families added that a text search for the extracted name finds and whose name is similar enough.

    Each distinct name is a query to one inverted index of the known contents,
    all in one join; added rows have no dense score and are not safe to merge.
    """
    names = extracted.where(F.trim("name") != "").select(F.trim("name").alias("query")).distinct()
    found = se.bm25_join(names, known, "query", "family_id", "content", hits)
    near = found.join(known.select("family_id", F.col("name").alias("known_name")), "family_id").withColumn("lexical_score", F.round(jaccard("query", "known_name"), 6)).where(F.col("lexical_score") >= lexical)
    more = extracted.select("pos", F.trim("name").alias("query")).join(near, "query").select("pos", "family_id", "lexical_score")
    more = more.join(candidates.select("pos", "family_id"), ["pos", "family_id"], "left_anti").select("*", F.lit(0.0).alias("dense_score"), F.col("lexical_score").alias("score"), F.lit(False).alias("merge_safe"))
    by = Window.partitionBy("pos").orderBy(F.desc("score"), "family_id")
    return candidates.drop("rank").unionByName(more).withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top)


def decide(scored: DataFrame) -> DataFrame:
    """Decision by score: a version of the known entity, a new one, or a case for the judge."""
    kind = F.when((F.col("score") >= SAME_VERSION) & (F.lower(core_name("left_name")) == F.lower(core_name("right_name"))), "version").when(F.col("score") < NEW_ENTITY, "new").otherwise("judge")
    return scored.withColumn("decision", kind)


def similar_contents(rows: DataFrame, threshold: float = 0.65) -> DataFrame:
    """Groups of contents whose character sets overlap by more than the threshold: ``id``, ``group``.

    Equal character sets are compared once, others by an overlap join.
    """
    chars = rows.select("id", F.array_sort(characters(F.lower(F.trim(F.coalesce("content", F.lit("")))))).alias("set"))
    kinds = materialize(chars.groupBy("set").agg(F.min("id").alias("rep")), "character-sets")
    sets = kinds.where(F.size("set") > 0).select(F.col("rep").alias("id"), F.col("set").alias("tokens"))
    links = overlap_join(sets, sets, threshold).where(F.col("left_id") < F.col("right_id")).where(F.col("similarity") > threshold)
    groups = connected_components(links.select(F.col("left_id").alias("u"), F.col("right_id").alias("v")), "u", "v")
    final = kinds.join(groups, kinds["rep"] == groups["id"], "left").select("set", F.coalesce("component", "rep").alias("group"))
    return chars.join(final, "set").select("id", "group")


def merge_across_windows(entities: DataFrame, threshold: float = MERGE_ACROSS) -> DataFrame:
    """Redirects between families of one name whose vectors agree; the family with most versions stays."""
    rank = Window.partitionBy("name").orderBy(F.desc("version_count"), "family_id")
    rows = entities.withColumn("_rank", F.row_number().over(rank))
    first = rows.where("_rank = 1").select("name", F.col("family_id").alias("target_family_id"), F.col("embedding").alias("_e"))
    near = rows.where("_rank > 1").join(first, "name").withColumn("similarity", F.round(cosine("embedding", "_e"), 6))
    return near.where(F.col("similarity") >= threshold).select(F.col("family_id").alias("source_family_id"), "target_family_id", "similarity")


def duplicate_names(entities: DataFrame) -> DataFrame:
    """Core names that several families share."""
    return entities.groupBy(core_name("name").alias("core")).agg(F.countDistinct("family_id").alias("families"), F.array_sort(F.collect_set("family_id")).alias("members")).where("families >= 2")


def orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Families of one version that no relation touches."""
    single = entities.groupBy("family_id").agg(F.count("*").alias("n")).where("n <= 1")
    linked = edges.select(F.explode(F.array("fam1", "fam2")).alias("family_id")).distinct()
    return single.join(linked, "family_id", "left_anti").select("family_id")
