import re
from collections import Counter, defaultdict

import pyarrow as pa

from chronoloom.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, term string, value long, n long, p long"


def brute(rows, least=3, top=200):
    docs = [(t or "", lang or "", s or "") for t, lang, s in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(low)) for t, _, _ in docs]
    df, held, out = defaultdict(Counter), defaultdict(Counter), set()
    for (_, lang, s), ts in zip(docs, terms, strict=True):
        df[lang].update(set(ts))
        held[lang, s].update(ts)
    for lang in {x for _, x, _ in docs}:
        kept = [t for t, n in df[lang].items() if n >= least]
        sources = sorted(s for x, s in held if x == lang)
        p = {}
        for s in sources:
            c = {t: held[lang, s][t] for t in kept}
            p[s] = {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}
        whole = {t: sum(held[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 1) // (sum(whole.values()) + len(kept)) for t in kept}
        gap = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(gap(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            marks = [(t, gap(p[s][t], q[t])) for t in kept if held[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", pairs), ("term", marks)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, v, i + 1) for i, (item, v) in enumerate(found) if part == "pair" or i < top}
    return out


def run(spark, rows, **options):
    data = [(i, *r, "x", -1, -1, -1) for i, r in enumerate(rows)]
    return {tuple(r) for r in dv.audit(spark.createDataFrame(data, SCHEMA), **options).collect()}


ODD = [
    ("The cat, the dog", "en", "a"), ("the CAT sat", "en", "b"), ("A cat's the thing", "en", "a"), ("the dog the dog", "en", "b"), (None, "en", "c"), ("", "en", "d"), ("thé ÉA é", "en", "b"), ("cat dog", "en", None),
    ("der hund", None, "a"), ("der hund Hund", None, None), ("hund der", "", "z"), ("allein", "xx", "only"), ("Same same", "t", "s1"), ("same Same", "t", "s2"), ("same", "t", "s3"), ("x" * 100_000 + " the", "en", "a"), ("x" * 100_000, "en", "c"), ("x" * 100_000, "en", "c"),
]


def test_against_brute_force_with_nulls_ties_and_repeats(spark):
    assert run(spark, ODD) == brute(ODD)


def test_parts_of_the_vocabulary_and_stretches_change_nothing(spark):
    rows = [(" ".join(f"w{(i * j) % 37}x" + "ab"[j % 2] for j in range(40)), "en", f"s{i % 7}") for i in range(60)]
    want = brute(rows)
    assert run(spark, rows) == want
    assert run(spark, rows, part_chars=20, stretch=500) == want


def test_terms_are_ranked_to_the_bound(spark):
    rows = [(" ".join(f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)), "en", "a")] * 3 + [("other words here", "en", "b")] * 3
    got = run(spark, rows, top=5)
    assert got == brute(rows, top=5)
    assert max(r[5] for r in got if r[2] == "term" and r[1] == "a") == 5


def test_sums_of_counts_beyond_64_bits(spark):
    """Shares come from decimals: a billion times a count of ten billion."""
    one = spark.createDataFrame([(10**10, 3 * 10**10)], "n long, `all` long").select(dv._share("n", "`all`").alias("p")).first().p
    assert one == 1 + 10**9 * (10**10 + 1) // (3 * 10**10)


def test_no_rows(spark):
    assert run(spark, []) == set()
    assert run(spark, [(None, None, None)]) == set()
    assert run(spark, [(None, None, "a"), ("", None, "b")]) == {("", "a", "pair", "b", 0, 1), ("", "b", "pair", "a", 0, 1)}


def test_a_stretch_gives_each_distinct_term_to_the_automata_once(spark, monkeypatch):
    """Scanning grew with texts times parts, and each stretch built every part's automaton anew."""
    terms = spark.createDataFrame([(f"term{chr(97 + i)}é",) for i in range(20)], "term string")
    numbered = dv.numbered(terms)
    ids = {r.term: r.id for r in numbered.collect()}
    assert sorted(ids, key=ids.get) == sorted(ids, key=str.encode)
    vocabulary = dv.write_vocabulary(numbered, 80)[:2]
    built, build, machines = [], dv._terms, {}
    monkeypatch.setattr(dv, "_terms", lambda uri: built.append(uri) or build(uri))
    schema = pa.schema([("lang", pa.string()), ("source", pa.string()), ("text", pa.string())])
    batch = pa.RecordBatch.from_pylist([{"lang": "x", "source": s, "text": "termaé TERMBé other " * 500} for s in "aab"], schema)
    got = Counter()
    for _ in range(3):
        (tally,) = dv.tallies(iter([batch, batch]), ("lang", "source"), False, 1 << 20)
        assert tally.names.to_pylist() == ["termaé", "termbé", "other"]  # 9,000 words of a stretch
        found = dv.term_ids(tally.names, vocabulary, machines)
        for g, c, n in zip(tally.group, tally.code, tally.n, strict=True):
            got[tally.keys[g], tally.names[int(c)].as_py(), int(found[c])] += int(n)
    assert sorted(built) == sorted(vocabulary) and len(built) == 2
    monkeypatch.setattr(dv, "KEPT_CHARS", 1)
    one: dict = {}
    assert [dv.term_ids(tally.names, vocabulary, one).tolist() for _ in range(3)] == [found.tolist()] * 3
    assert len(one) == 1 and len(built) == 2 + 2 + 1 + 1  # the automaton at hand comes first
    held = {t for uri in vocabulary for t in spark.read.parquet(uri).toPandas()["term"]}
    assert got == {(("x", s), t, ids[t] if t in held else -1): n for s, n in (("a", 6000), ("b", 3000)) for t in ("termaé", "termbé", "other")}
