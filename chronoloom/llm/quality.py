"""Quality rules with risk-controlled thresholds, in DataFrame functions only.

Each rule compares a measure of a text with a cutoff from a fixed grid.  In
every stratum (language) the labelled good documents are a holdout: a cutoff is
admissible if an exact binomial bound says, at level ``delta`` divided by the
number of all tests (Bonferroni), that it rejects less than ``risk`` over the
number of rules of the good documents.  The strictest admissible cutoff is used,
so with probability 1 - ``delta`` no stratum loses more than ``risk`` of its
good documents to the rules.  Cutoffs never depend on the data beyond that.

The bound: a cutoff that rejects ``k`` of ``n`` good documents passes if
P(Binomial(n, risk) <= k) is at most the level (Clopper-Pearson, inverted).

Defined cases: null texts have no words; null languages are a stratum of their
own; a stratum without good labels admits no cutoff and keeps what the base
rules keep; several labels of one id count as good only if all say so; rows
that repeat an id are judged each; empty tables give no rows; other columns are
not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronoloom.plans.materialize import materialize

RISK, DELTA = 0.05, 0.05
#: Strata whose cutoffs are sent to every task; more are joined instead.
MOST_STRATA = 10_000
#: (rule, measure, unit, cutoffs from strict to lax): a text fails where measure > cutoff * unit.
RULES = [
    ("symbols", "1000 * n_symbols", "word_chars", [10, 20, 30, 50, 80, 120, 200, 300, 500]),
    ("dup_lines", "1000 * n_dup_lines", "n_words", [2, 5, 10, 20, 40, 80, 160]),
    ("repeats", "1000 * n_repeat_words", "n_words", [10, 20, 50, 100, 150, 200, 250]),
    ("short", "-n_words", "1", [-200, -100, -60, -50, -40, -30, -25]),
    ("long_words", "10 * word_chars", "n_words", [60, 65, 70, 75, 80, 90, 100, 120, 150, 200]),
]
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"
_GAP = r"[\x20\x09-\x0D]+"
_SPACES = "".join(map(chr, (32, 9, 10, 11, 12, 13)))
_SYMBOLS = "#*$%&|<>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(hashes: Column, window: int) -> Column:
    """Words that windows found twice or more cover, from the windows' hashes in text order."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, i: F.least(F.lit(window), F.coalesce(F.get(places, i + 1) - p, F.lit(window))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def twice(ranked: Column) -> Column:
        again = F.filter(
            ranked,
            lambda x, i: F.coalesce(F.get(ranked, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(ranked, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return _let(F.array_sort(F.transform(again, lambda x: x["p"])), covered)

    ranked = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)).otherwise(_let(ranked, twice))


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str = "lang", window: int = 8) -> DataFrame:
    """The base measures of every text; each text is read once and stays in its row."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(stratum).cast("string"), F.lit("\0")).alias("stratum"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("body"),
    )
    split = rows.withColumn("words", F.filter(F.split("body", _GAP), lambda w: w != "")).withColumn(
        "lines", F.filter(F.split("body", "\n"), lambda x: F.translate(x, _SPACES, "") != "")
    )
    size = F.size("words")
    hashed = split.withColumn(
        "hashes",
        F.when(
            size >= window, F.transform(F.sequence(F.lit(1), size - F.lit(window - 1)), lambda i: F.xxhash64(F.slice("words", i, F.lit(window))))
        ).otherwise(F.array().cast("array<bigint>")),
    )
    return hashed.select(
        "doc_id",
        "stratum",
        size.cast("long").alias("n_words"),
        F.length(F.translate("body", _SPACES, "")).cast("long").alias("word_chars"),
        (F.length("body") - F.length(F.translate("body", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _repeat_words(F.col("hashes"), window).cast("long").alias("n_repeat_words"),
    )


def _fails(rule: tuple, cutoff: Column) -> Column:
    return F.expr(rule[1]) > cutoff * F.expr(rule[2])


def _at_most(k: Column, n: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k) where k <= n * risk, else one."""
    import math

    start, odds = n * F.lit(math.log1p(-risk)), math.log(risk / (1 - risk))

    def step(a: Column, i: Column) -> Column:
        t = a["t"] + F.log((n - i + 1) / i) + F.lit(odds)
        return F.struct(t.alias("t"), (a["s"] + F.exp(t)).alias("s"))

    total = F.aggregate(F.sequence(F.lit(1).cast("long"), k), F.struct(start.alias("t"), F.exp(start).alias("s")), step)["s"]
    return F.when(k > n * F.lit(risk), F.lit(1.0)).when(k == 0, F.exp(start)).otherwise(total)


def cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, rules: list[tuple] = RULES) -> DataFrame:
    """One row for each stratum with good labels: the strictest admissible cutoff of every rule, or null.

    Counts of all labelled documents come from one aggregate with map-side
    combine; what follows has one row for each stratum, rule and cutoff.
    """
    good = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = measured.where(f"NOT ({BASE_FAILED})").join(good, "doc_id", "left_semi")
    counts = [F.sum(F.when(_fails(r, F.lit(c)), 1).otherwise(0)).alias(f"{r[0]}:{i}") for r in rules for i, c in enumerate(r[3])]
    totals = held.groupBy("stratum").agg(F.count("*").alias("n"), *counts)
    tests = F.explode(F.array(*[
        F.struct(F.lit(r[0]).alias("rule"), F.lit(c).alias("cutoff"), F.col(f"`{r[0]}:{i}`").alias("k")) for r in rules for i, c in enumerate(r[3])
    ]))
    rows = materialize(totals.select("stratum", "n", tests.alias("t")).select("stratum", "n", "t.*"), "cutoffs")
    level = delta / max(1, rows.count())
    passed = rows.where(_at_most(F.col("k"), F.col("n"), risk / len(rules)) <= level)
    strictest = [F.min(F.when(F.col("rule") == r[0], F.col("cutoff"))).alias(f"cut_{r[0]}") for r in rules]
    return passed.groupBy("stratum").agg(*strictest)


def judge(docs: DataFrame, labels: DataFrame, risk: float = RISK, delta: float = DELTA, rules: list[tuple] = RULES, **columns) -> DataFrame:
    """Measures, ``base_failed`` and ``kept`` of every document."""
    measured = materialize(measures(docs, **columns), "measures")
    used = materialize(cutoffs(measured, labels, risk, delta, rules), "cutoffs")
    small = used.count() <= MOST_STRATA
    rows = measured.join(F.broadcast(used) if small else used, "stratum", "left")
    failed = F.lit(False)
    for r in rules:
        failed = failed | F.coalesce(_fails(r, F.col(f"cut_{r[0]}")), F.lit(False))
    base = F.expr(BASE_FAILED)
    return rows.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base.alias("base_failed"), (~base & ~failed).alias("kept"),
    )


def _oracle() -> str:
    tests = " UNION ALL ".join(
        f"SELECT '{r[0]}' AS rule, {c} AS cutoff, stratum, count(*) AS n, count(*) FILTER ({r[1]} > {c} * {r[2]}) AS k FROM held GROUP BY stratum"
        for r in RULES for c in r[3]
    )
    risk = RISK / len(RULES)
    cuts = ", ".join(f"min(cutoff) FILTER (rule = '{r[0]}') AS cut_{r[0]}" for r in RULES)
    fails = " OR ".join(f"coalesce({r[1]} > cut_{r[0]} * {r[2]}, false)" for r in RULES)
    return f"""
WITH rows AS (SELECT doc_id, coalesce(lang, chr(0)) AS stratum, coalesce(text, '') AS body FROM documents),
split AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words,
  list_filter(string_split(body, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines FROM rows),
windows AS (SELECT doc_id, i, list_slice(words, i, i + 7) AS w FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM split WHERE len(words) >= 8)),
twice AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1),
spread AS (SELECT doc_id, count(DISTINCT i + d) AS n FROM twice, range(0, 8) t(d) GROUP BY doc_id),
measured AS (SELECT s.doc_id, stratum, len(words)::BIGINT AS n_words, coalesce(list_sum(list_transform(words, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(body) - length(translate(body, '{_SYMBOLS}', '')))::BIGINT AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words
  FROM split s LEFT JOIN spread USING (doc_id)),
held AS (SELECT * FROM measured WHERE NOT ({BASE_FAILED}) AND doc_id IN (SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1)),
tests AS ({tests}),
passed AS (SELECT * FROM tests WHERE k <= n * {risk!r} AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) <= {DELTA!r} / (SELECT count(*) FROM tests)),
cuts AS (SELECT stratum, {cuts} FROM passed GROUP BY stratum)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ({BASE_FAILED}) AS base_failed,
  NOT ({BASE_FAILED}) AND NOT ({fails}) AS kept
FROM measured LEFT JOIN cuts USING (stratum)"""


ORACLE = _oracle()
