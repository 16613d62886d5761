import zlib

import numpy as np

from chronoloom.llm import toxicity as t


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    net = t.Network(5, rng, np.float64)
    x = rng.normal(size=(6, 3, t.WORD_DIM + t.CHAR_DIM))
    mask = np.array([[1, 1, 1]] * 4 + [[1, 0, 1]] * 2, float)
    y, w = np.array([1.0, 0, 1]), np.array([1.0, 2, 1])
    _, g, dx = net.gradients(x, mask, y, w)
    for k in ("Wf", "Wb", "Uf", "Ub", "bf", "bb", "A", "v", "o", "c"):
        for at in [tuple(rng.integers(0, n) for n in net.p[k].shape) for _ in range(4)]:
            old = net.p[k][at]
            both = []
            for e in (1e-5, -1e-5):
                net.p[k][at] = old + e
                both.append(net.gradients(x, mask, y, w)[0])
            net.p[k][at] = old
            assert abs((both[0] - both[1]) / 2e-5 - g[k][at]) < 1e-6, k
    for at in [(0, 0, 1), (3, 1, 9), (5, 2, 4)]:
        old = x[at]
        both = []
        for e in (1e-5, -1e-5):
            x[at] = old + e
            both.append(net.gradients(x, mask, y, w)[0])
        x[at] = old
        assert abs((both[0] - both[1]) / 2e-5 - dx[at]) < 1e-6


def test_windows_cover_every_word_and_overlap():
    for n in (0, 1, 31, 32, 33, 47, 48, 49, 500):
        s = t.window_starts(n)
        seen = np.zeros(max(n, 1), int)
        for a in s:
            seen[a : a + t.WINDOW] += 1
        assert s[0] == 0 and (n == 0 or seen[:n].min() >= 1) and (np.diff(s) <= t.STRIDE).all()


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{n}.parquet") for n in ("documents", "labels"))
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(truth[r.doc_id], r.score, r.predicted) for r in t.toxicity(docs.join(labels.select("doc_id"), "doc_id"), labels).where("held_out").collect()]
    pos, neg = [s for y, s, _ in held if y], [s for y, s, _ in held if not y]
    assert np.mean([[p > n for n in neg] for p in pos]) > 0.93
    assert np.mean([y == p for y, _, p in held]) > 0.95 and np.mean([p for y, _, p in held if y]) > 0.8


def test_odd_rows(spark, sf001):
    docs, labels = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/labels.parquet")
    odd = [(10**7, None), (10**7 + 1, ""), (10**7 + 2, "..."), (None, "no id"), (1, "repeated id"), (10**7 + 3, "long word " * 30000)]
    every = docs.select("doc_id", "text").unionAll(spark.createDataFrame(odd, "doc_id long, text string")).selectExpr("*", "1 as score", "'x' as predicted")
    rows = t.toxicity(every, labels).collect()
    assert len(rows) == docs.count() + len(odd)
    for r in rows:
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    assert {r.predicted for r in rows if r.doc_id in (10**7, 10**7 + 1, 10**7 + 2)} == {0}
    assert t.toxicity(every.where("false"), labels).count() == 0
    assert {r.score for r in t.toxicity(every.limit(5), labels.where("false")).collect()} == {0.0}
