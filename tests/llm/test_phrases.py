import re
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from chronoloom.llm import phrases as ph

SCHEMA = "text string, lang string, phrase string, f long, n long, k int"


def brute(rows, least, top=2000, cover=80):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = set()
    for lang in {x or "und" for _, x in rows}:
        f, n = Counter(), 0
        for text, own in rows:
            if (own or "und") != lang:
                continue
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(low)):
                w = re.findall(r"[^\x20\x09]+", piece)
                n += len(w)
                f.update(tuple(w[i : i + m]) for m in range(1, 5) for i in range(len(w) - m + 1))
        often = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: len(p) < len(q) and any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in often.items():
            if any(inside(p, q) and 100 * b >= cover * a for q, b in often.items()):
                continue
            score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top]):
            out.add((lang, i + 1, p.decode(), -a, l, r, n, -s))
    return out


def run(spark, rows, least, **options):
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], SCHEMA)
    return {tuple(r) for r in ph.collocations(docs, least, **options).collect()}


ROWS = [
    ("the red fox, the red fox jumps. THE RED", "en"), ("the red fox\tjumps over; the red", "en"), (None, "en"), ("", None), ("der rote fuchs\nder rote", None), ("der rote fuchs", "und"), ("Der rote!", "und"),
    ("a a a a a a a", "en"), ("é É é É\x0bé É", "fr"), ("  ...  ", "fr"), ("long " * 3000, "en"), ("x" * 50_000 + " y " + "x" * 50_000 + " y", "en"),
]


@pytest.mark.parametrize("least", [2, 3])
def test_against_brute_force_with_nulls_overlaps_and_long_texts(spark, least):
    assert run(spark, ROWS, least) == brute(ROWS, least)


def test_prefixes_grown_by_counts_give_the_same(spark, monkeypatch):
    rows = [(" ".join("abcd"[(i * j + j // 3) % 4] for j in range(60)), "en") for i in range(20)]
    want = brute(rows, 5)
    assert run(spark, rows, 5) == want
    monkeypatch.setattr(ph, "HOT", 0)
    monkeypatch.setattr(ph, "HOT_SHARE", 1 << 60)
    assert run(spark, rows, 5) == want


def test_bits_that_rare_words_share_lose_and_add_nothing(spark, monkeypatch):
    monkeypatch.setattr(ph, "BITS", 8)
    monkeypatch.setattr(ph, "PIECE", 8)
    assert run(spark, ROWS, 2) == brute(ROWS, 2)


def test_ranks_end_at_the_bound_and_ties_go_by_bytes(spark):
    rows = [("b c. B d. é f. a z", "en")] * 3
    assert run(spark, rows, 3, top=2) == brute(rows, 3, top=2)


def test_no_rows(spark):
    assert run(spark, [], 2) == set()


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.text("ab, \n", max_size=40), st.sampled_from(["en", None])), max_size=8))
def test_any_texts(spark, rows):
    assert run(spark, rows, 2) == brute(rows, 2)
