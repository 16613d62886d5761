import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd

from chronoloom.llm import suffixes


def covered(bodies, length):
    seen = Counter(hash(b[i : i + length]) for b in bodies for i in range(len(b) - length + 1))
    for b in bodies:
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - length + 1):
            if seen[hash(b[i : i + length])] > 1:
                gone[i] += 1
                gone[i + length] -= 1
        yield np.cumsum(gone)[:-1] > 0


def brute(rows, length=400, passage=suffixes.PASSAGE):
    bodies = [(t or "").encode() for _, t in rows]
    out = []
    for (d, _), b, mask, short in zip(rows, bodies, covered(bodies, length), covered(bodies, passage)):
        edge = np.flatnonzero(mask & ~np.r_[False, mask[:-1]]) if len(mask) else []
        kept = bytes(np.frombuffer(b, np.uint8)[~mask]) if len(b) else b""
        out.append((d, len(b), int(mask.sum()), len(edge), hashlib.sha256(kept).hexdigest(), int(short.sum())))
    return sorted(out, key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passage").collect()), key=repr)


def naive(s):
    return sorted(range(len(s)), key=lambda i: tuple(s[i:]))


def test_arrays_and_prefixes_of_random_strings():
    rng = np.random.default_rng(0)
    for t in range(300):
        s = rng.integers(0, int(rng.integers(1, 5)), int(rng.integers(1, 60))).astype(np.uint8)
        s = np.tile(s, 3) if t % 5 == 0 else s
        sa = suffixes.suffix_array(s)
        assert sa.tolist() == naive(s)
        prefix = np.zeros(len(s), int)
        for r in range(1, len(sa)):
            i, j, k = sa[r], sa[r - 1], 0
            while max(i, j) + k < len(s) and s[i + k] == s[j + k]:
                k += 1
            prefix[i] = k
        assert suffixes.permuted_prefixes(s, sa).tolist() == prefix.tolist()


def test_arrays_of_large_alphabets(monkeypatch):
    rng = np.random.default_rng(1)
    for t in range(200):
        s = rng.integers(0, int(rng.integers(1, 40)), int(rng.integers(1, 120)))
        s = np.tile(s[: 1 + t % 7], 20) if t % 4 == 0 else s
        monkeypatch.setattr(suffixes, "FEW_BUCKETS", 0)
        assert suffixes.suffix_array(s).tolist() == naive(s.tolist())
    monkeypatch.undo()
    s = rng.integers(0, 5000, 30_000)
    sa = suffixes.suffix_array(np.r_[s, s[:9000], s])
    text = np.r_[s, s[:9000], s].astype(">u2").tobytes()
    assert all(text[2 * a :] < text[2 * b :] for a, b in zip(sa[:-1:97].tolist(), sa[1::97].tolist()))


def test_whole_table(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    want = brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert got(suffixes.remove_repeats(docs)) == want
    assert sum(r[2] for r in want) > 0


def test_odd_rows_and_crowded_anchors(spark):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randrange(1, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage = text(200)
    rows = [(1, None), (2, ""), (3, "short"), (None, passage), (4, "a" * 1500), (5, "ab" * 700), (6, passage[:399]), (7, passage[:405])]
    for i in range(40):
        k, a, b = rng.randrange(380, 700), text(rng.randrange(0, 60)), text(rng.randrange(0, 60))
        s = rng.randrange(0, max(1, len(passage) - k))
        rows.append((100 + i, a + passage[s : s + k] + b))
    rows += [(200, "same id " + passage)] * 2 + [(200, "other text")] + [(300, text(3000))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as key", "2 as body", "3 as starts")
    want = brute(rows)
    for shard, group in ((3 << 20, 24 << 20), (2000, 3000)):
        assert got(suffixes.remove_repeats(df, shard_bytes=shard, group_bytes=group)) == want
    assert suffixes.remove_repeats(df.where("false")).count() == 0


def test_texts_longer_than_a_segment(spark):
    rng = random.Random(4)
    long = "".join(rng.choice("abcdefghij ") for _ in range(1_300_000))
    rows = [(1, long), (2, "x" + long[999_700:1_000_300] + "y"), (3, long[1_299_000:])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(suffixes.remove_repeats(df)) == brute(rows)


def test_names_of_leftmost_smaller_substrings():
    rng = np.random.default_rng(2)
    for t in range(200):
        s = rng.integers(0, int(rng.integers(2, 6)), int(rng.integers(8, 200)))
        s = np.tile(s[: 3 + t % 60], 9) if t % 3 == 0 else s
        small = suffixes.suffix_types(s)
        spots = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        if len(spots) < 2:
            continue
        ends = [*(spots[1:] + 1), len(s)]
        strings = [tuple(zip(s[a:b].tolist(), small[a:b].tolist())) for a, b in zip(spots, ends)]
        order = {x: i for i, x in enumerate(sorted(set(strings)))}
        names, different = suffixes.substring_names(s, small, spots, int(s.max()) + 1)
        assert names.tolist() == [order[x] for x in strings] and different == len(order)


class Plan:
    """Stands for a DataFrame; hands out the function of its partitions."""

    def repartition(self, *_):
        return self

    sortWithinPartitions = repartition

    def mapInPandas(self, run, schema):
        return run


def test_shards_are_put_together_by_batches_not_by_anchors(monkeypatch):
    """Each document's contexts and each anchor's rows were frames of their own, which took longer than sorting them."""
    rng = np.random.default_rng(3)
    bodies = [bytes(rng.integers(97, 100, 600).astype(np.uint8)) for _ in range(90)]
    bodies[7] = bodies[3][:550] + bodies[7][550:]
    n = 10
    wanted = pd.DataFrame({"key": range(90), "body": bodies, "ah": [np.arange(n) * 5 + 90 * (k % 4) for k in range(90)], "a": [np.arange(n) * 10] * 90, "b": [np.arange(n) * 10 + 9] * 90, "e": [np.arange(n) * 10 + 9 + 400] * 90})
    frames = list(suffixes.context_rows(Plan())(iter([wanted])))
    assert len(frames) == 1
    rows = frames[0].sort_values("ah", kind="stable", ignore_index=True)
    assert rows["context"].tolist() == [bodies[k][a : a + 409] for k, a in zip(rows["key"], rows["a"], strict=True)] and set(rows["places"]) == {10}
    pieces, concat = [], pd.concat
    monkeypatch.setattr(suffixes.pd, "concat", lambda held, **o: pieces.append(len(held)) or concat(held, **o))
    find = lambda limit, group, step: sorted({(r.key, x, r.size) for f in suffixes.shard_rows(Plan(), (255, 400), limit, group)(rows.iloc[i : i + step] for i in range(0, len(rows), step)) for r in f[f["kind"] == 1].itertuples() for x in range(r.a, r.b)})
    whole = find(1 << 30, 1 << 30, 300)
    assert pieces == [4]  # three batches and the last anchor
    assert {k for k, _, _ in whole} == {3, 7} and {z for _, _, z in whole} == {255, 400}
    assert find(1, 1 << 30, 77) == find(5_000, 1 << 30, 1) == whole


def test_a_last_substring_that_begins_another_has_a_name_of_its_own():
    """It shared a name where it ended just with a word of symbols (21 of this alphabet before)."""
    for n in range(3, 60):
        s = np.array([2, *[0] * n, 1, 2, 2, 1, 2, *[0] * n, 1, 2])
        small = suffixes.suffix_types(s)
        spots = np.flatnonzero(small[1:] & ~small[:-1]) + 1
        assert suffixes.substring_names(s, small, spots, 3)[0].tolist() == [1, 2, 0]
        assert suffixes.suffix_array(s).tolist() == sorted(range(len(s)), key=lambda i: s[i:].tolist())


def test_common_prefixes_at_the_end_of_the_text():
    for n in range(2, 40):
        for s in (np.zeros(n, np.uint8), np.tile(np.array([1, 0, 0], np.uint8), n)[:n]):
            sa = suffixes.suffix_array(s)
            near = suffixes.permuted_prefixes(s, sa)
            for a, b in zip(sa[:-1], sa[1:], strict=True):
                both = int(n - max(a, b))
                same = s[a : a + both] == s[b : b + both]
                assert near[b] == (both if same.all() else int(np.argmin(same)))
