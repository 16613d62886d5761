import hashlib
import random
import re
from collections import Counter

import pytest

from chronoloom.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, window=35):
    texts = [WORD.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in texts for i in range(len(w) - window + 1))
    out = []
    for (d, _), w in zip(rows, texts):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr)


@pytest.mark.parametrize("period", [7, 13, 21, 31])
def test_any_two_places_share_a_covered_shift(period):
    cover = set(substrings.difference_cover(period))
    for i in range(period):
        for j in range(period):
            assert any((i + d) % period in cover and (j + d) % period in cover for d in range(period))


def test_whole_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(substrings.remove_repeats(docs)) == want
    assert sum(r[2] for r in want) > 0


def test_odd_rows(spark):
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(4000)}"
    passage = [word() for _ in range(60)]
    rows = [(1, None), (2, ""), (3, "few words"), (None, " ".join(passage)), (4, "a " * 500), (5, "\t".join(passage[:34]) + " end"), (6, "é ü " * 40)]
    for i in range(60):
        w = [word() for _ in range(rng.randrange(0, 90))]
        k = rng.randrange(20, 61)
        s = rng.randrange(0, 61 - k)
        rows.append((100 + i, " ".join(w[: len(w) // 2] + passage[s : s + k] + w[len(w) // 2 :])))
    rows += [(200, "x y " + " ".join(passage))] * 2 + [(200, "another text of the same id")] + [(300, " ".join(word() for _ in range(20000)))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as body", "3 as starts")
    assert got(substrings.remove_repeats(df)) == brute(rows)
    assert substrings.remove_repeats(df.where("false")).count() == 0
    kept = substrings.remove_repeats(df, with_text=True)
    assert kept.where("sha2(kept, 256) <> kept_sha256").count() == 0
