"""Scores of whole texts against a plain loop over words, windows and steps."""

import math

import numpy as np

from chronoloom.llm import toxicity as t


def brute_score(model, text):
    p, known = model["params"], model["known"]
    words = t.tokens(text)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def enter(word):
        rows, n = t.grams([word])
        chars = p["char"][rows].mean(axis=0) if n[0] else np.zeros(t.CHAR_DIM)
        return np.concatenate([p["word"][known.get(word, t.UNKNOWN)], chars]).astype(float)

    def walk(xs, d):
        h, out = np.zeros(t.HIDDEN), []
        for x in xs:
            g, u = x @ p["W" + d] + p["b" + d], h @ p["U" + d]
            z, r = sig(g[: t.HIDDEN] + u[: t.HIDDEN]), sig(g[t.HIDDEN : 2 * t.HIDDEN] + u[t.HIDDEN : 2 * t.HIDDEN])
            n = np.tanh(g[2 * t.HIDDEN :] + r * u[2 * t.HIDDEN :])
            h = (1 - z) * n + z * h
            out.append(h)
        return out

    best = -math.inf
    for a in t.window_starts(len(words)):
        xs = [enter(w) for w in words[a : a + t.WINDOW]]
        if not xs:
            hs = np.zeros((t.WINDOW, 2 * t.HIDDEN))
        else:
            hs = np.concatenate([walk(xs, "f"), walk(xs[::-1], "b")[::-1]], axis=1)
        e = np.tanh(hs @ p["A"]) @ p["v"]
        w = np.exp(e - e.max())
        best = max(best, float((w / w.sum()) @ hs @ p["o"] + p["c"][0]))
    return sig(model["slope"] * best + model["shift"])


def test_scores_match_a_plain_loop(spark, sf001):
    docs, labels = spark.read.parquet(f"{sf001}/documents.parquet"), spark.read.parquet(f"{sf001}/labels.parquet")
    model = t.fit(docs, labels)
    rows = [tuple(r) for r in docs.where("doc_id % 40 = 0").select("doc_id", "text").collect()] + [(-1, None), (-2, ""), (-3, "..."), (-4, "unseen wörds " * 40)]
    got = {r.doc_id: r.score for r in t.scored_rows(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    for d, text in rows:
        assert abs(got[d] - brute_score(model, text)) < 1e-3
