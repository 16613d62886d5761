"""Toxicity by a bidirectional gated recurrent network with attention pooling.

A word enters as its own embedding and the mean embedding of its character
n-grams, so unseen forms of known stems are read too.  The network runs over
all windows of ``WINDOW`` words, ``STRIDE`` apart, of every whole text; a text
scores as its worst window.  Labels belong to texts, not to windows: in each
epoch the network picks the window it finds worst in every training text
(multiple-instance learning).  Everything is numpy; training takes place on a
bounded sample of labelled rows, scoring in the tasks that read the texts.

Sample bound: at most ``SAMPLE`` toxic and twice as many other labelled texts
of at most ``SAMPLE_CHARS`` characters, lowest hashes of their ids first.

Defined cases: null and empty texts have no words and score as one empty
window; a null id counts as empty text for the held-out fold; without labels of
both classes the score is the smoothed share of label 1 (zero without labels);
rows that repeat an id are scored each; an empty table gives no rows; labels,
languages, sources and ids are no inputs of a score.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronoloom.llm.common import kept, ragged_take, tidy
from chronoloom.llm.decontaminate import words_of

WINDOW, STRIDE = 32, 16
HIDDEN, WORD_DIM, CHAR_DIM, ATTENTION = 8, 8, 8, 8
MOST_WORDS, BUCKETS, GRAMS = 20_000, 1 << 15, (3, 4, 5)
SAMPLE, SAMPLE_CHARS = 1000, 20_000
EPOCHS, BATCH, RATE, SEED = 5, 128, 0.01, 11
#: Steps that training takes at least, in several passes over a small sample.
LEAST_STEPS = 300
FOLDS = 5
#: Characters of text that are scored at once.
PART_CHARS = 400_000
#: Distinct words whose inputs a worker keeps.
CACHE_WORDS = 100_000
PAD, UNKNOWN = 0, 1


def tokens(text: str | None) -> list[bytes]:
    return words_of((text or "").lower())


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' character (byte) n-grams, ends marked, and how many each word has."""
    sizes = np.array([len(w) + 2 for w in words], np.int64)
    data = np.frombuffer(b"".join([b"<" + w + b">" for w in words]) + bytes(max(GRAMS)), np.uint8).astype(np.uint64)
    ends = np.cumsum(sizes)
    whose = np.repeat(np.arange(len(words)), sizes)
    place = np.arange(len(whose))
    buckets, owners = [], []
    key = np.zeros(len(whose), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        key = key * np.uint64(0x100000001B3) + data[n - 1 : n - 1 + len(whose)] + np.uint64(n)
        if n in GRAMS:
            here = place + n <= ends[whose] if len(words) else np.zeros(0, bool)
            buckets.append(((key[here] * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64))
            owners.append(whose[here])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return np.concatenate(buckets)[order], np.bincount(owner, minlength=len(words))


def window_starts(n: int) -> np.ndarray:
    """Starts of all windows of a text of ``n`` words; the last one ends with it."""
    if n <= WINDOW:
        return np.zeros(1, np.int64)
    return np.r_[np.arange(0, n - WINDOW, STRIDE), n - WINDOW].astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Parameters and passes; arrays are time first."""

    def __init__(self, words: int, rng: np.random.Generator, dtype=np.float32):
        d, h = WORD_DIM + CHAR_DIM, HIDDEN
        init = lambda *s: (rng.normal(size=s) / np.sqrt(s[0])).astype(dtype)
        self.p = {
            "word": (0.1 * rng.normal(size=(words, WORD_DIM))).astype(dtype), "char": (0.1 * rng.normal(size=(BUCKETS, CHAR_DIM))).astype(dtype),
            "Wf": init(d, 3 * h), "Wb": init(d, 3 * h), "Uf": init(h, 3 * h), "Ub": init(h, 3 * h), "bf": np.zeros(3 * h, dtype), "bb": np.zeros(3 * h, dtype),
            "A": init(2 * h, ATTENTION), "v": init(ATTENTION, 1)[:, 0], "o": init(2 * h, 1)[:, 0], "c": np.zeros(1, dtype),
        }
        self.p["word"][PAD] = self.p["word"][UNKNOWN] = 0

    def _gru(self, gates: np.ndarray, mask: np.ndarray, U: np.ndarray, keep: list | None) -> np.ndarray:
        """States (T, B, H) for input gates (T, B, 3H); a masked step repeats the state."""
        T, B, _ = gates.shape
        H = HIDDEN
        h = np.zeros((B, H), gates.dtype)
        out = np.empty((T, B, H), gates.dtype)
        for t in range(T):
            u = h @ U
            zr = sigmoid(gates[t, :, : 2 * H] + u[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            n = np.tanh(gates[t, :, 2 * H :] + r * u[:, 2 * H :])
            m = mask[t][:, None]
            new = m * (n + z * (h - n)) + (1 - m) * h
            if keep is not None:
                keep.append((h, z, r, n, u[:, 2 * H :]))
            out[t] = h = new
        return out

    def pooled(self, gf: np.ndarray, gb: np.ndarray, mask: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits from input gates of both directions (the backward ones in text order)."""
        p = self.p
        kf, kb = ([], []) if keep is not None else (None, None)
        hf = self._gru(gf, mask, p["Uf"], kf)
        hb = self._gru(gb[::-1], mask[::-1], p["Ub"], kb)[::-1]
        h = np.concatenate([hf, hb], axis=2)
        a = np.tanh(h @ p["A"])
        e = a @ p["v"]
        e = np.where(mask > 0, e, -1e9)
        e = np.exp(e - e.max(axis=0))
        w = e / e.sum(axis=0)
        c = (w[:, :, None] * h).sum(axis=0)
        if keep is not None:
            keep.update(kf=kf, kb=kb, h=h, a=a, w=w, c=c)
        return c @ p["o"] + p["c"][0]

    def _gru_back(self, dh_out: np.ndarray, mask: np.ndarray, U: np.ndarray, kept: list) -> tuple[np.ndarray, np.ndarray]:
        T, B, H = dh_out.shape
        dg = np.zeros((T, B, 3 * H), dh_out.dtype)
        dU = np.zeros_like(U)
        dh = np.zeros((B, H), dh_out.dtype)
        for t in range(T - 1, -1, -1):
            h, z, r, n, un = kept[t]
            dh = dh + dh_out[t]
            m = mask[t][:, None]
            d = dh * m
            dn = d * (1 - z) * (1 - n * n)
            dz = d * (h - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            dg[t] = np.concatenate([dz, dr, dn], axis=1)
            du = np.concatenate([dz, dr, dn * r], axis=1)
            dU += h.T @ du
            dh = dh * (1 - m) + d * z + du @ U.T
        return dg, dU

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Loss, gradients of the shared parameters and of the inputs ``x`` (T, B, D)."""
        p, keep = self.p, {}
        T, B, D = x.shape
        logit = self.pooled(x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"], mask, keep)
        s = sigmoid(logit)
        total = weight.sum()
        loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / total)
        dl = (weight * (s - y) / total).astype(x.dtype)
        g = {"o": keep["c"].T @ dl, "c": np.array([dl.sum()], x.dtype)}
        dc = dl[:, None] * p["o"]
        h, w, a = keep["h"], keep["w"], keep["a"]
        dh = w[:, :, None] * dc
        dw = (h * dc).sum(axis=2)
        de = w * (dw - (w * dw).sum(axis=0))
        g["v"] = np.einsum("tb,tbk->k", de, a)
        da = de[:, :, None] * p["v"] * (1 - a * a)
        g["A"] = h.reshape(-1, 2 * HIDDEN).T @ da.reshape(-1, ATTENTION)
        dh = dh + da @ p["A"].T
        df, g["Uf"] = self._gru_back(dh[:, :, :HIDDEN], mask, p["Uf"], keep["kf"])
        db, g["Ub"] = self._gru_back(dh[::-1, :, HIDDEN:], mask[::-1], p["Ub"], keep["kb"])
        db = db[::-1]
        flat = x.reshape(-1, D)
        for d, k in ((df, "f"), (db, "b")):
            g["W" + k] = flat.T @ d.reshape(-1, 3 * HIDDEN)
            g["b" + k] = d.sum(axis=(0, 1))
        return loss, g, df @ p["Wf"].T + db @ p["Wb"].T


class Vocabulary:
    """Numbers of the words of some texts, with the parts of each word's input."""

    def __init__(self, known: dict[bytes, int]):
        self.known = known
        self.numbers: dict[bytes, int] = {}
        self.word = np.array([PAD])
        self.sizes, self.flat = np.zeros(1, np.int64), np.zeros(0, np.int64)

    def add(self, words: list[bytes]) -> np.ndarray:
        numbers = self.numbers
        new = list(dict.fromkeys(w for w in words if w not in numbers))
        if new:
            first = len(self.word)
            numbers.update(zip(new, range(first, first + len(new)), strict=True))
            self.word = np.r_[self.word, np.array([self.known.get(w, UNKNOWN) for w in new])]
            flat, sizes = grams(new)
            self.sizes, self.flat = np.r_[self.sizes, sizes], np.r_[self.flat, flat]
        return np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))

    def inputs(self, p: dict, first: int = 0) -> np.ndarray:
        """Input vectors of the words from number ``first`` on."""
        sizes = self.sizes[first:]
        flat = self.flat[len(self.flat) - int(sizes.sum()) :]
        out = np.zeros((len(sizes), WORD_DIM + CHAR_DIM), p["word"].dtype)
        out[:, :WORD_DIM] = p["word"][self.word[first:]]
        out[:, WORD_DIM:] = mean_rows(p["char"], flat, sizes)
        return out


def mean_rows(table: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean of each run of rows; zero for an empty run."""
    out = np.zeros((len(sizes), table.shape[1]), table.dtype)
    some = np.flatnonzero(sizes)
    if len(some):
        at = np.cumsum(sizes[some]) - sizes[some]
        out[some] = np.add.reduceat(table[rows], at, axis=0) / sizes[some, None]
    return out


def _layout(counts: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window, for texts stored one after another."""
    starts, lengths, owner, at = [], [], [], 0
    for k, n in enumerate(counts):
        s = window_starts(n)
        starts.append(s + at)
        lengths.append(np.minimum(n - s, WINDOW))
        owner.append(np.full(len(s), k))
        at += n
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return join(starts), join(lengths), join(owner)


def _grid(ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers and mask of windows, time first."""
    t = np.arange(WINDOW)[:, None]
    inside = t < lengths
    at = np.where(inside, starts + t, 0)
    return np.where(inside, ids[at] if len(ids) else 0, PAD), inside.astype(np.float32)


def logits(net: Network, gates: np.ndarray, ids: np.ndarray, counts: list[int], block: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Logit and text of every window; ``gates`` holds both directions' input gates of each word."""
    starts, lengths, owner = _layout(counts)
    out = np.empty(len(starts), np.float32)
    for a in range(0, len(starts), block):
        grid, mask = _grid(ids, starts[a : a + block], lengths[a : a + block])
        g = gates[grid]
        out[a : a + block] = net.pooled(g[:, :, : 3 * HIDDEN], g[:, :, 3 * HIDDEN :], mask)
    return out, owner


def _gates(p: dict, x: np.ndarray) -> np.ndarray:
    return np.concatenate([x @ p["Wf"] + p["bf"], x @ p["Wb"] + p["bb"]], axis=1).astype(np.float32)


def _log_odds(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    return np.clip(np.log((pos + 0.5) / (n_pos + 1)) - np.log((neg + 0.5) / (n_neg + 1)), -3, 3)


def train(texts: list[str], toxic: list[int], epochs: int = EPOCHS, seed: int = SEED) -> dict:
    """Fit the network to texts; the model is a plain dictionary of arrays."""
    if len(set(toxic)) == 2:  # a text without words speaks for nothing
        blank = 1 + len(toxic) // 50
        texts, toxic = [*texts, *[""] * blank], [*toxic, *[0] * blank]
    y = np.array(toxic, np.float32)
    if not len(y) or y.min() == y.max():
        return {"constant": float((y.sum() + 0.0) / (len(y) + 1)) if len(y) else 0.0}
    rng = np.random.default_rng(seed)
    words = [tokens(t) for t in texts]
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    seen: list[Counter] = [Counter(), Counter()]
    for w, k in zip(words, y, strict=True):
        seen[int(k)].update(set(w))
    every = seen[0] + seen[1]
    ranked = sorted((w for w, n in every.items() if n >= 3), key=lambda w: (-every[w], w))[:MOST_WORDS]
    known = {w: i + 2 for i, w in enumerate(ranked)}
    net = Network(len(ranked) + 2, rng)
    p = net.p
    # The first dimension of both embeddings starts as the class log-odds of its word or n-gram.
    p["word"][2:, 0] = _log_odds(np.array([seen[1][w] for w in ranked]), np.array([seen[0][w] for w in ranked]), n_pos, n_neg)
    vocabulary = Vocabulary(known)
    counts = [len(w) for w in words]
    ids = vocabulary.add([w for ws in words for w in ws])
    flat = np.split(ids, np.cumsum(counts)[:-1])
    del words, seen, every  # ids stand for them from here on
    sizes, gram_of = vocabulary.sizes, vocabulary.flat
    gram_at = np.cumsum(sizes) - sizes
    by_text = np.zeros((2, BUCKETS))
    for f, k in zip(flat, y, strict=True):
        kinds = np.unique(f)
        by_text[int(k), np.unique(gram_of[ragged_take(gram_at[kinds], sizes[kinds])])] += 1
    p["char"][:, 0] = _log_odds(by_text[1], by_text[0], n_pos, n_neg) * (by_text.sum(axis=0) >= 3)
    starts, lengths, owner = _layout(counts)
    bounds = np.searchsorted(owner, np.arange(len(y) + 1))
    word_of = vocabulary.word
    odds = np.r_[0, np.cumsum(vocabulary.inputs(p)[:, [0, WORD_DIM]].sum(axis=1)[ids])]
    first = odds[starts + lengths] - odds[starts]
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step, score = 0, first
    for epoch in range(epochs):
        if epoch:
            score, _ = logits(net, _gates(p, vocabulary.inputs(p)), ids, counts)
        worst = np.array([bounds[k] + int(np.argmax(score[bounds[k] : bounds[k + 1]])) for k in range(len(y))])
        other = bounds[:-1] + rng.integers(0, np.diff(bounds))
        quiet = other[y == 0]
        picked = np.concatenate([worst, quiet])
        wanted = np.concatenate([y, np.zeros(len(quiet), np.float32)])
        passes = -(-LEAST_STEPS * BATCH // (epochs * len(picked)))
        order = np.concatenate([rng.permutation(len(picked)) for _ in range(max(1, passes))])
        for a in range(0, len(order), BATCH):
            use = picked[order[a : a + BATCH]]
            target = wanted[order[a : a + BATCH]]
            grid, mask = _grid(ids, starts[use], lengths[use])
            local, inverse = np.unique(grid, return_inverse=True)
            inverse = inverse.reshape(grid.shape)
            word = np.where(rng.random(len(local)) < 0.2, UNKNOWN, word_of[local])
            own = sizes[local]
            parts = gram_of[ragged_take(gram_at[local], own)]
            x = np.concatenate([p["word"][word], mean_rows(p["char"], parts, own)], axis=1)
            _, g, dx = net.gradients(x[inverse], mask, target, np.ones(len(target), np.float32))
            dlocal = np.zeros_like(x)
            np.add.at(dlocal, inverse.reshape(-1), dx.reshape(-1, dx.shape[2]))
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], word, dlocal[:, :WORD_DIM])
            g["word"][[PAD, UNKNOWN]] = 0
            each = dlocal[:, WORD_DIM:] / np.maximum(own, 1)[:, None]
            spread = np.repeat(each, own, axis=0)
            for k in range(CHAR_DIM):
                g["char"][:, k] = np.bincount(parts, spread[:, k], BUCKETS)
            step += 1
            for k, v in p.items():
                m, s = moments[k]
                m += 0.1 * (g[k] - m)
                s += 0.001 * (g[k] ** 2 - s)
                v -= (RATE * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)).astype(v.dtype)
    score, _ = logits(net, _gates(p, vocabulary.inputs(p)), ids, counts)
    worst = np.maximum.reduceat(score, bounds[:-1])
    slope, shift = _calibrate(worst.astype(np.float64), y)
    return {"params": p, "known": known, "slope": slope, "shift": shift}


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic scale of the texts' worst logits (penalised Newton steps), rising."""
    z = (x - x.mean()) / (x.std() + 1e-9)
    w = np.zeros(2)
    f = np.stack([z, np.ones_like(z)], axis=1)
    for _ in range(30):
        s = sigmoid(f @ w)
        grad = f.T @ (s - y) + np.array([0.1, 0.0]) * w
        curve = f.T @ (f * (s * (1 - s))[:, None]) + np.diag([0.1, 1e-6])
        w -= np.linalg.solve(curve, grad)
    slope = max(w[0], 1e-3) / (x.std() + 1e-9)
    return float(slope), float(w[1] - slope * x.mean())


class Scorer:
    """Scores texts with a model; inputs of words stay known from batch to batch."""

    def __init__(self, model: dict):
        self.model = model
        if "params" in model:
            self.net = Network.__new__(Network)
            self.net.p = model["params"]
            self._clear()

    def _clear(self) -> None:
        self.words = Vocabulary(self.model["known"])
        self.gates = _gates(self.net.p, self.words.inputs(self.net.p))
        self.filled = 1

    def score(self, texts: list[str | None]) -> np.ndarray:
        if "constant" in self.model:
            return np.full(len(texts), self.model["constant"])
        if not texts:
            return np.zeros(0)
        if len(self.words.word) > CACHE_WORDS:
            self._clear()
        lists = [tokens(t) for t in texts]
        counts = [len(w) for w in lists]
        ids = self.words.add([w for ws in lists for w in ws])
        n = len(self.words.word)
        if n > self.filled:
            if n > len(self.gates):
                self.gates = np.concatenate([self.gates, np.zeros((max(n, 2 * len(self.gates)) - len(self.gates), self.gates.shape[1]), np.float32)])
            self.gates[self.filled : n] = _gates(self.net.p, self.words.inputs(self.net.p, self.filled))
            self.words.flat, self.words.sizes = self.words.flat[:0], np.zeros(n, np.int64)  # their gates are known now
            self.filled = n
        out, owner = logits(self.net, self.gates, ids, counts)
        worst = np.maximum.reduceat(out, np.searchsorted(owner, np.arange(len(texts)))).astype(np.float64)
        return sigmoid(self.model["slope"] * worst + self.model["shift"])


def fold(doc_id):
    """The remainder that decides whether a row is held out."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(FOLDS))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_chars: int = SAMPLE_CHARS, epochs: int = EPOCHS) -> dict:
    """Train on a bounded sample of labelled rows outside the held-out fold."""
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = known.where(fold(F.col("doc_id")) != 0)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    short = rows.where(F.length("text") <= sample_chars)
    # Ids are chosen first, without their texts; only the chosen texts move.
    named = short.select("doc_id").join(known, "doc_id").distinct().withColumn("spot", F.md5(F.col("doc_id").cast("string")))
    parts = [named.where(F.col("toxic") == t).orderBy("spot").limit(n) for t, n in ((1, sample), (0, 2 * sample))]
    chosen = docs.sparkSession.createDataFrame([tuple(r) for r in parts[0].unionAll(parts[1]).select("doc_id", "toxic").collect()], "doc_id long, toxic int")
    texts = short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    got = sorted((r.doc_id, r.text, r.toxic) for r in texts.collect())
    return train([t for _, t, _ in got], [k for _, _, k in got], epochs)


def _scorer(name: str, sent) -> Scorer:
    """One scorer for each worker process, whose words stay known from task to task."""
    return kept(f"toxicity:{name}", lambda: Scorer(sent.value))


def _in_parts(scorer: Scorer, texts: list[str | None], size: int = PART_CHARS) -> np.ndarray:
    """Scores of texts, some characters at a time."""
    out, a = np.empty(len(texts)), 0
    while a < len(texts):
        b, total = a, 0
        while b < len(texts) and (b == a or total + len(texts[b] or "") < size):
            total += len(texts[b] or "")
            b += 1
        out[a:b] = scorer.score(texts[a:b])
        a = b
    return out


def scored_rows(docs: DataFrame, model: dict) -> DataFrame:
    """``doc_id`` and ``score`` of every row."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = _scorer(name, sent)
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "score": _in_parts(own, pdf["text"].tolist())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(tidy(run, True), "doc_id long, score double")


def without_toxic(docs: DataFrame, model: dict, cut: float = 0.5) -> DataFrame:
    """The rows that score below the cut, with all their columns as they are."""
    sent, name = docs.sparkSession.sparkContext.broadcast(model), uuid.uuid4().hex
    at = docs.columns.index("text")
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])  # Python functions take no names with dots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _scorer(name, sent)
        for batch in batches:
            yield batch.filter(pa.array(_in_parts(own, batch.column(at).to_pylist()) < cut))

    return plain.mapInArrow(tidy(run, True), plain.schema).toDF(*docs.columns)


def toxicity(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``held_out``, ``score``, ``predicted`` of every document."""
    rows = scored_rows(docs, fit(docs, labels, **options))
    return rows.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
