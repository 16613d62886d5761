import hashlib
import re

from chronoloom.llm import decontaminate as d

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(t):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items, window=10):
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    sizes = {len(k) for k in wins}
    out = []
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in wins:
                    hit.update(range(k, k + n))
                    named |= wins[tuple(w[k : k + n])]
        named = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_whole_table(spark, sf001):
    docs, items = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/benchmark.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert got(d.contamination(docs, items)) == want
    assert got(d.contamination(docs, items, block_words=5000, chunk_bytes=2000)) == want
    assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_odd_rows(spark):
    item = "the quick brown fox jumps over the lazy dog again today"
    items = [(1, item), (1, item), (2, "short one"), (10, "short ONE"), (3, None), (4, "..."), (None, "nameless phrase here"), (5, "rep rep rep rep rep rep rep rep rep rep")]
    docs = [(1, None), (2, ""), (3, f"x {item.upper()}! y"), (3, f"x {item.upper()}! y"), (4, "a short one b short one"), (None, "rep " * 30), (6, "the quick brown fox jumps over the lazy dog"), (7, "nameless-phrase\nhere"), (8, "short"), (9, "one " + "z " * 40000 + "short one")]
    a = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as block", "'q' as items")
    b = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 as item")
    for words_, chunk in ((400_000, 1 << 20), (15, 30)):
        assert got(d.contamination(a, b, block_words=words_, chunk_bytes=chunk)) == brute(docs, items)
    assert d.contamination(a.where("false"), b).count() == 0
    assert {r[5] for r in d.contamination(a, b.where("false")).collect()} == {False}


def test_proximity(spark):
    a = spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "gamma beta alpha"), (4, "alpha x y z beta w gamma")], "doc_id long, text string")
    b = spark.createDataFrame([(7, "alpha beta gamma")], "item_id long, text string")
    index = d.build_index(a)
    near = lambda slop: sorted(r.doc_id for r in d.search(index, b, slop=slop).where("size(items) > 0").collect())
    assert near(0) == [1] and near(1) == [1, 2] and near(3) == [1, 2] and near(4) == [1, 2, 3, 4]


def test_many_phrase_files_lose_no_document(spark):
    docs = [(None, "alpha beta gamma"), (None, "delta epsilon zeta"), (1, "alpha beta gamma"), (1, "eta theta iota"), (2, None)]
    items = [(i, t) for i, t in enumerate(["alpha beta gamma", "delta epsilon zeta", "eta theta iota", "kappa", "lambda mu"])]
    a, b = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string").coalesce(1)
    for block in (1, 3, 4, 100):
        for chunk in (1, 20, 1 << 20):
            assert got(d.contamination(a, b, block_words=block, chunk_bytes=chunk)) == brute(docs, items)


def brute_near(docs, items, slop, window=10):
    out = []
    wins = {}
    for i, t in items:
        w = words(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            wins.setdefault(tuple(w[k : k + window]), set()).add(i)
    for i, t in docs:
        w, hit, named = words(t), set(), set()
        for s in range(len(w)):
            for g, who in wins.items():
                if g[0] == w[s] and all(x in w[max(0, s + o - slop) : max(0, s + o + slop + 1)] for o, x in enumerate(g) if o):
                    hit.update(range(s, min(s + len(g), len(w))))
                    named |= who
        named = sorted(str(x) for x in named if x is not None)
        out.append((i, len(w), len(hit), len(named), hashlib.sha256(",".join(named).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=repr)


def test_proximity_over_any_blocks(spark):
    import random

    rng = random.Random(5)
    docs = [(i if i % 7 else None, " ".join(rng.choice("abcde") for _ in range(rng.randrange(40)))) for i in range(60)]
    docs += [(100, "Lead " + "the quick red brown fox jumps over a lazy dog at noon"), (101, None)]
    items = [(i, " ".join(rng.choice("abcde") for _ in range(rng.randrange(1, 9)))) for i in range(12)]
    items += [(None, "a b c"), (50, "the quick brown fox jumps over lazy dog at noon today"), (51, "e"), (52, "")]
    a, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for slop in (1, 2, 3):
        want = brute_near(docs, items, slop)
        for words_, chunk in ((400_000, 1 << 20), (25, 12)):
            assert got(d.contamination(a, b, slop=slop, block_words=words_, chunk_bytes=chunk)) == want
        assert any(r[5] for r in want) and not all(r[5] for r in want)


def test_rounds_of_few_candidates(spark, sf001):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf001}/documents.parquet").select("doc_id", "text").limit(300).collect()]
    found = [d.Found(r) for r in d.build_index(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).toPandas().itertuples(index=False)]
    phrases = d.Phrases([(str(i), t) for i, t in rows[::3]] + [("rep", "x " * 500), (None, "y")], 10)
    for f in found:
        for slop in (0, 2):
            one = sorted(x for k, s, p in d.search_block(f.block, phrases, slop) for x in zip(k.tolist(), s.tolist(), p.tolist()))
            few = sorted(x for k, s, p in d.search_block(f.block, phrases, slop, most=50) for x in zip(k.tolist(), s.tolist(), p.tolist()))
            assert one == few and len(one) > 1000
