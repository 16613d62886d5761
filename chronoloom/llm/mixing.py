"""Mixing sources to target weights by hierarchical budgets, in DataFrame functions only.

Documents hang below a tree of domain, language and source.  The token budget
flows from the root: siblings share their parent's budget by weight; a node
that holds less than its share (its tokens times ``max_epochs``) is filled, and
what it can't take goes to its siblings first, then, since a parent's capacity
is the sum of its children's, to its ancestors' siblings.  A leaf's budget is
read as whole epochs and the prefix of one more, in an order seeded by epoch
and id.

Leaves are cut into hash buckets whose totals give the bucket in which a prefix
ends; only that bucket's rows are sorted.  One source may hold any share of the
rows; only rows of one id, or of one text and no id, stay together.

Defined cases: a null text has no words and follows its order at no cost; null
languages and sources are nodes of their own; a node without a weight has
``default_weight``, one of weight zero gets nothing; a row without an id is
placed by its text; rows that repeat an id, or a text without one, share a place
and are counted each, those of fewer words first, ties by the rows' contents, so
only rows equal in every column tie; an empty table gives no rows; all columns
of the input are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chronoloom.plans.materialize import materialize

SEED, BUDGET_SHARE, MAX_EPOCHS = 17, 0.6, 4
#: Hex digits of the order's hash that name a bucket.
BUCKET_DIGITS = 4
#: Leaves whose budgets are sent to every task; more are joined instead.
MOST_LEAVES = 50_000
LEVELS = ["domain", "language", "source"]
#: Weights by level and name; others have the default weight.
WEIGHTS = {"domain": {"d0": 5, "d1": 3, "d2": 2}, "language": {"en": 6, "de": 2, "fr": 2, "es": 1}, "source": {}}


def domain_of(source: Column) -> Column:
    """The three domains of the query's tree: the number at a source's end, modulo three."""
    number = F.regexp_extract(F.coalesce(source, F.lit("")), "([0-9]{1,9})$", 1)
    return F.concat(F.lit("d"), F.pmod(F.when(number == "", F.lit(0)).otherwise(number.try_cast("int")), F.lit(3)).cast("string"))


def _weight(level: str, weights: dict, default: int) -> Column:
    out = F.lit(default)
    for name, w in weights.get(level, {}).items():
        out = F.when(F.col(level) == name, F.lit(w)).otherwise(out)
    return out.cast("long")


def share_out(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Adds ``budget``: the parent's ``given`` shared among siblings by ``weight``, none above its ``capacity``.

    Exact in integers: siblings are filled from the smallest capacity for its
    weight up while the rest allows each its share; the others divide what is
    left, rounded so that nothing is lost.  Quotients are taken before products
    and the one comparison of products is in decimals, so any count of tokens
    that a long holds can be shared.
    """
    whole = lambda c: F.col(c).cast("decimal(19,0)")
    able = nodes.withColumn("room", F.when(F.col("weight") > 0, F.col("capacity")).otherwise(0)).withColumn("weight", F.greatest("weight", F.lit(0)))
    weighed = F.col("weight") > 0
    rank, finer = F.when(weighed, F.expr("room div weight")).otherwise(F.lit(-1)), F.when(weighed, F.expr("room % weight * 1000000 div weight"))
    by = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    order = by.orderBy("rank", "finer", name)
    upto, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    rows = (
        able.withColumn("rank", rank)
        .withColumn("finer", finer)
        .withColumn("number", F.row_number().over(order))
        .withColumn("filled", F.coalesce(F.sum("room").over(upto), F.lit(0)))
        .withColumn("weights_left", F.sum("weight").over(after))
        .withColumn("short", whole("room") * whole("weights_left") <= whole("weight") * (whole("given") - whole("filled")))
        .withColumn("turn", F.min(F.when(~F.col("short"), F.col("number"))).over(by))
        .withColumn("is_short", F.col("turn").isNull() | (F.col("number") < F.col("turn")))
        .withColumn("left", F.col("given") - F.coalesce(F.sum(F.when(F.col("is_short"), F.col("room"))).over(by), F.lit(0)))
        .withColumn("all_weights", F.sum(F.when(~F.col("is_short"), F.col("weight"))).over(by))
        .withColumn("run", F.sum(F.when(~F.col("is_short"), F.col("weight"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    )
    upto_run = "(left div all_weights) * ({0}) + (left % all_weights) * ({0}) div all_weights"
    part = F.expr(f"{upto_run.format('run')} - ({upto_run.format('run - weight')})")
    budget = F.when(F.col("is_short"), F.col("room")).otherwise(F.least("room", part))
    return rows.withColumn("budget", budget).select(*nodes.columns, "budget")


def leaf_budgets(leaves: DataFrame, budget: int | Column, levels: list[str], weights: dict, default_weight: int = 1) -> DataFrame:
    """Budgets of the leaves (``levels``, ``tokens``, ``capacity``); the trees hold one row for each node."""
    given = leaves.agg(F.sum("capacity").alias("all")).select(F.least(F.coalesce(F.col("all"), F.lit(0)), F.lit(budget)).alias("given"))
    parents: list[str] = []
    above = given
    for level in levels:
        nodes = leaves.groupBy(*parents, level).agg(F.sum("tokens").alias("tokens"), F.sum("capacity").alias("capacity"))
        nodes = nodes.join(F.broadcast(above)) if not parents else nodes.join(above, parents)
        shared = share_out(nodes.withColumn("weight", _weight(level, weights, default_weight)), parents, level)
        parents = [*parents, level]
        above = shared.select(*parents, F.col("budget").alias("given"))
    return shared.select(*levels, "tokens", "budget")


def mix(docs: DataFrame, budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS, seed: int = SEED, weights: dict = WEIGHTS, default_weight: int = 1, budget: int | None = None, domain: Column | None = None, doc_id: str = "doc_id", text: str = "text", language: str = "lang", source: str = "source", bucket_digits: int = BUCKET_DIGITS) -> DataFrame:
    """``row`` (all columns of the input), the tree's levels, ``n_tokens`` and ``copies`` of every document."""
    name = lambda c: F.coalesce(c.cast("string"), F.lit("\0"))
    base = docs.select(
        F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]).alias("row"),
        F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("#"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")))).alias("ident"),
        (domain if domain is not None else domain_of(F.col(source))).alias("domain"),
        name(F.col(language)).alias("language"),
        name(F.col(source)).alias("source"),
        F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("n_tokens"),
    )
    counted = materialize(base.select("ident", *LEVELS, "n_tokens"), "mix-counts")
    leaves = counted.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens")).withColumn("capacity", F.col("tokens") * F.lit(max_epochs))
    leaves = materialize(leaves, "mix-leaves")
    if budget is None:
        budget = int((leaves.agg(F.sum("tokens")).first()[0] or 0) * round(budget_share * 1000)) // 1000
    planned = leaf_budgets(leaves, budget, LEVELS, weights, default_weight)
    planned = planned.withColumn("epochs", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0).cast("long")))
    planned = materialize(planned.select(*LEVELS, "epochs", (F.col("budget") - F.col("epochs") * F.col("tokens")).alias("rest")), "mix-plan")
    few = planned.count() <= MOST_LEAVES

    def ordered(rows: DataFrame, plan: DataFrame) -> DataFrame:
        with_plan = rows.join(F.broadcast(plan) if few else plan, LEVELS)
        spot = F.md5(F.concat_ws("|", F.lit(seed).cast("string"), F.col("epochs").cast("string"), F.col("ident")))
        return with_plan.withColumn("spot", spot).withColumn("bucket", F.substring("spot", 1, bucket_digits))

    totals = ordered(counted, planned).groupBy(*LEVELS, "rest", "bucket").agg(F.sum("n_tokens").alias("n"))
    run = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ends = totals.withColumn("upto", F.sum("n").over(run))
    last = ends.where("upto > rest").groupBy(*LEVELS).agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("before"))).alias("m"))
    last = last.select(*LEVELS, F.col("m.bucket").alias("edge"), F.col("m.before").alias("before"))
    plan = materialize(planned.join(last, LEVELS, "left"), "mix-edges")
    placed = ordered(base, plan)
    out = ["row", *LEVELS, "n_tokens"]
    sure = placed.where("edge is null or bucket <> edge").select(
        *out, (F.col("epochs") + F.when(F.col("edge").isNull() | (F.col("bucket") < F.col("edge")), 1).otherwise(0)).alias("copies")
    )
    within = Window.partitionBy(*LEVELS).orderBy("spot", "ident", "n_tokens", "last").rowsBetween(Window.unboundedPreceding, 0)
    edge = placed.where("bucket = edge").withColumn("last", F.md5(F.to_json("row").cast("binary"))).withColumn("upto", F.col("before") + F.sum("n_tokens").over(within))
    return sure.unionAll(edge.select(*out, (F.col("epochs") + F.when(F.col("upto") <= F.col("rest"), 1).otherwise(0)).alias("copies")))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The input's rows, each as often as its copies say."""
    rows = mix(docs, **options).where("copies > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def _share_sql(name: str, nodes: str, parent: str, level: str) -> str:
    """The same division in plain SQL."""
    return f"""
{name}0 AS (SELECT *, CASE WHEN weight > 0 THEN capacity ELSE 0 END AS room FROM ({nodes})),
{name}1 AS (SELECT *, CASE WHEN weight > 0 THEN room::HUGEINT * 1000000 // weight ELSE -1 END AS rank FROM {name}0),
{name}2 AS (SELECT *, row_number() OVER o AS number, coalesce(sum(room) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
  sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_left FROM {name}1 WINDOW o AS (PARTITION BY {parent} ORDER BY rank, {level})),
{name}3 AS (SELECT *, min(CASE WHEN NOT (room::HUGEINT * weights_left <= weight::HUGEINT * (given - filled)) THEN number END) OVER (PARTITION BY {parent}) AS turn FROM {name}2),
{name}4 AS (SELECT *, turn IS NULL OR number < turn AS is_short FROM {name}3),
{name}5 AS (SELECT *, given - coalesce(sum(CASE WHEN is_short THEN room END) OVER (PARTITION BY {parent}), 0) AS lft,
  sum(CASE WHEN NOT is_short THEN weight END) OVER (PARTITION BY {parent}) AS allw,
  sum(CASE WHEN NOT is_short THEN weight END) OVER (PARTITION BY {parent} ORDER BY rank, {level} ROWS UNBOUNDED PRECEDING) AS run FROM {name}4),
{name} AS (SELECT *, CASE WHEN is_short THEN room ELSE least(room, (lft::HUGEINT * run) // allw - (lft::HUGEINT * (run - weight)) // allw) END AS budget FROM {name}5)"""


def oracle(budget_share: float = BUDGET_SHARE, max_epochs: int = MAX_EPOCHS) -> str:
    """The copies of every document in SQL, over a table ``documents``."""
    case = lambda level: "CASE " + " ".join(f"WHEN {level} = '{k}' THEN {v}" for k, v in WEIGHTS[level].items()) + " ELSE 1 END" if WEIGHTS[level] else "1"
    sums = "sum(tokens)::BIGINT AS tokens, sum(capacity)::BIGINT AS capacity"
    one = f"SELECT domain, {sums}, (SELECT least(sum(capacity), (SELECT sum(tokens) FROM leaves)::BIGINT * {round(budget_share * 1000)} // 1000) FROM leaves)::BIGINT AS given, {case('domain')} AS weight FROM leaves GROUP BY domain"
    two = f"SELECT a.domain, a.language, a.tokens, a.capacity, p.budget::BIGINT AS given, {case('language').replace('language =', 'a.language =')} AS weight FROM (SELECT domain, language, {sums} FROM leaves GROUP BY ALL) a JOIN l1 p USING (domain)"
    three = "SELECT a.domain, a.language, a.source, a.tokens, a.capacity, p.budget::BIGINT AS given, 1 AS weight FROM leaves a JOIN l2 p USING (domain, language)"
    return f"""
WITH base AS (SELECT doc_id, 'd' || (coalesce(try_cast(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1) AS BIGINT), 0) % 3)::VARCHAR AS domain,
  coalesce(lang, chr(0)) AS language, coalesce(source, chr(0)) AS source, coalesce(doc_id::VARCHAR, '#' || md5(coalesce(text, ''))) AS ident,
  len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {max_epochs})::BIGINT AS capacity FROM base GROUP BY ALL),
{_share_sql("l1", one, "1", "domain")}, {_share_sql("l2", two, "domain", "language")}, {_share_sql("l3", three, "domain, language", "source")},
plan AS (SELECT domain, language, source, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs, budget - CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END * tokens AS rest FROM l3),
placed AS (SELECT base.*, epochs, rest, md5(concat_ws('|', '{SEED}', epochs::BIGINT::VARCHAR, ident)) AS spot FROM base JOIN plan USING (domain, language, source)),
run AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, language, source ORDER BY spot, ident, n_tokens ROWS UNBOUNDED PRECEDING) AS upto FROM placed)
SELECT doc_id, domain, language, source, n_tokens, (epochs + CASE WHEN upto <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM run"""


ORACLE = oracle()
