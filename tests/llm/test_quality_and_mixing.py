import re
from collections import Counter
from math import comb

from pyspark.sql import functions as F

from chronoloom.llm import mixing, quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def measures(t):
    t = t or ""
    w = WORD.findall(t)
    wins = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    hit = {i + k for i in range(len(w) - 7) if wins[tuple(w[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def base_failed(m):
    return m[0] < 20 or 100 * m[4] > 30 * m[0]


def fails(rule, cut, m):
    scope = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), m))
    return eval(rule[1], {}, scope) > cut * eval(rule[2], {}, scope)


def brute(rows, labels):
    good = {}
    for d, q in labels:
        good[d] = min(q, good.get(d, q))
    measured = [(d, lang or "\0", measures(t)) for d, t, lang in rows]
    held = [(s, m) for d, s, m in measured if good.get(d) == 1 and not base_failed(m)]
    strata = {s for s, _ in held}
    level = quality.DELTA / max(1, len(strata) * sum(len(r[3]) for r in quality.RULES))
    risk = quality.RISK / len(quality.RULES)
    cuts = {}
    for s in strata:
        own = [m for x, m in held if x == s]
        for r in quality.RULES:
            for c in r[3]:
                k, n = sum(fails(r, c, m) for m in own), len(own)
                if sum(comb(n, i) * risk**i * (1 - risk) ** (n - i) for i in range(k + 1)) <= level:
                    cuts[s, r[0]] = c
                    break
    out = []
    for d, s, m in measured:
        bad = any((s, r[0]) in cuts and fails(r, cuts[s, r[0]], m) for r in quality.RULES)
        out.append((d, *m, base_failed(m), not base_failed(m) and not bad))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_quality_of_whole_table_with_odd_rows(spark, sf001):
    docs, labels = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/labels.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang").collect()]
    odd = [(10**7, None, None), (10**7 + 1, "", "en"), (10**7 + 2, "a\n\nb\n a\na\r\n", "xx"), (None, "x y " * 20, "en"), (1, "same id", "en"), (10**7 + 3, "ab " * 20000, "en"), (10**7 + 4, "w " * 7, None)]
    marks = [tuple(r) for r in labels.select("doc_id", "quality").collect()] + [(1, 0), (1, 1), (None, 1), (10**7 + 1, 1)]
    a = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").selectExpr("*", "1 as n_words", "2 as stratum", "3 as body")
    b = spark.createDataFrame(marks, "doc_id long, quality int")
    many = b.unionAll(spark.createDataFrame([(r[0], 1) for r in rows if r[0] % 3 and r[0] not in {m[0] for m in marks}], b.schema))
    all_marks = [tuple(r) for r in many.collect()]
    for labelled, known in ((b, marks), (many, all_marks)):
        assert got(quality.judge(a, labelled)) == brute(rows + odd, [m for m in known if m[0] is not None])
    assert quality.judge(a.where("false"), b).count() == 0
    assert [r.kept for r in quality.judge(a.limit(30), b.where("false")).collect()] == [not r.base_failed for r in quality.judge(a.limit(30), b.where("false")).collect()]


def test_thresholds_are_used_where_labels_suffice(spark):
    good = [(i, f"plain words of text number {i} " * 1 + " ".join(f"w{i}x{k}" for k in range(60)), "en") for i in range(1500)]
    bad = [(10_000 + i, "### $$$ " * 5 + " ".join(f"w{i}y{k}" for k in range(60)), "en") for i in range(50)]
    df = spark.createDataFrame(good + bad, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], 1) for r in good], "doc_id long, quality int")
    kept = {r.doc_id for r in quality.judge(df, labels).where("kept").collect()}
    assert len(kept & {r[0] for r in good}) >= 0.95 * len(good) and not kept & {r[0] for r in bad}


def fill(nodes, given):
    """Water level by repeated sharing, in exact fractions."""
    from fractions import Fraction

    got, live, left = {k: Fraction(0) for k in nodes}, dict(nodes), Fraction(given)
    while live:
        total = sum(w for w, _ in live.values())
        full = [k for k, (w, c) in live.items() if left * w >= c * total] if total else []
        if not full:
            for k, (w, _) in live.items():
                got[k] = left * w / total if total else Fraction(0)
            break
        for k in full:
            got[k] = Fraction(live[k][1])
        left -= sum(live.pop(k)[1] for k in full)
    return got


def test_budgets_follow_weights_and_pass_shortages_on(spark):
    leaves = [("d0", "en", "s1", 100), ("d0", "en", "s2", 5000), ("d0", "de", "s1", 50), ("d1", "en", "s3", 40), ("d2", "fr", "s4", 9000), ("d2", "en", "s5", 7000)]
    df = spark.createDataFrame([(*x, x[3]) for x in leaves], "domain string, language string, source string, tokens long, capacity long")
    for budget in (0, 1, 100, 3000, 9000, 15000, 10**6):
        out = {r[:3]: r.budget for r in map(lambda r: r, mixing.leaf_budgets(df, budget, mixing.LEVELS, mixing.WEIGHTS).collect())}
        assert sum(out.values()) == min(budget, sum(x[3] for x in leaves))
        dom = fill({d: (mixing.WEIGHTS["domain"][d], sum(x[3] for x in leaves if x[0] == d)) for d in ("d0", "d1", "d2")}, min(budget, sum(x[3] for x in leaves)))
        for d, share in dom.items():
            assert abs(sum(v for k, v in out.items() if k[0] == d) - share) <= 1
        for x in leaves:
            assert 0 <= out[x[:3]] <= x[3]


def test_mixing_odd_rows_and_prefixes(spark):
    rows = [(i, "w " * (i % 37), "en" if i % 3 else None, f"src{i % 2}") for i in range(900)]
    rows += [(None, "no id", "en", None), (5, "again", "de", "src1"), (5, "again", "de", "src1"), (6, None, "fr", "x"), (7, "", "fr", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").selectExpr("*", "1 as domain", "2 as copies", "3 as n_tokens")
    for digits in (1, 4):
        out = mixing.mix(df, budget_share=0.5, max_epochs=2, bucket_digits=digits).collect()
        assert len(out) == len(rows)
        total = sum(r.n_tokens for r in out)
        used = sum(r.n_tokens * r.copies for r in out)
        assert total * 0.3 < used <= total * 0.5
        assert max(r.copies for r in out) <= 2
        if digits == 1:
            first = sorted(repr(r) for r in out)
    assert first == sorted(repr(r) for r in out)
    assert mixing.mix(df.where("false")).count() == 0
    assert mixing.mixed(df, budget_share=1.0, max_epochs=1).columns == df.columns
    assert mixing.mixed(df, budget_share=1.0, max_epochs=1).count() == len(rows)


def test_rows_without_ids_are_drawn_by_seed(spark):
    """A hundred rows of different lengths: neither the shortest are kept nor does the order of rows matter."""
    rows = [(None, f"t{i} " + "w " * (3 * i + 1), "en", "src1") for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    kept = lambda d: sorted(r.row.text for r in mixing.mix(d, budget_share=0.5, max_epochs=1).collect() if r.copies)
    got = kept(df)
    shortest = sorted(t for _, t, _, _ in sorted(rows, key=lambda r: len(r[1]))[: len(got)])
    assert 30 < len(got) < 65 and len(set(got) & set(shortest)) < 0.8 * len(got)
    assert kept(df.repartition(7)) == got == kept(df.orderBy(F.desc("text")).coalesce(1))


def test_rows_that_share_an_id_do_not_tie(spark):
    rows = [(1, f"{x} y", "en", "s", i) for i, x in enumerate("abcdefgh")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, extra int")
    kept = lambda d: sorted(r.row.extra for r in mixing.mix(d, budget_share=0.5, max_epochs=1).collect() if r.copies)
    assert kept(df) == kept(df.repartition(5)) == kept(df.orderBy(F.desc("extra")).coalesce(1))


def test_budgets_of_a_hundred_terabytes(spark):
    from fractions import Fraction

    leaves = [(f"d{i % 3}", "en", f"s{i}", 10**15 + 7 * i, 4 * (10**15 + 7 * i)) for i in range(40)]
    df = spark.createDataFrame(leaves, "domain string, language string, source string, tokens long, capacity long")
    budget = 55 * 10**15 + 3
    out = {(r.domain, r.source): r.budget for r in mixing.leaf_budgets(df, budget, mixing.LEVELS, mixing.WEIGHTS).collect()}
    assert sum(out.values()) == budget
    shares = fill({d: (mixing.WEIGHTS["domain"][d], sum(x[4] for x in leaves if x[0] == d)) for d in ("d0", "d1", "d2")}, budget)
    for d, share in shares.items():
        assert abs(sum(v for k, v in out.items() if k[0] == d) - share) <= 1
    assert all(isinstance(x, (int, Fraction)) and x >= 0 for x in out.values())
