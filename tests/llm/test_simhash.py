import random
import re

import numpy as np
import xxhash

from chronoloom.llm import simhash


def brute_fingerprint(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    k = min(4, len(words))
    hs = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    arr = np.array(fps, np.uint64)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= distance):
            a, b = find(i), find(int(j))
            root[max(a, b)] = min(a, b)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(d, low.get(find(i), d))
    return sorted(((d, f"{f:016x}", low.get(find(i))) for i, ((d, _), f) in enumerate(zip(rows, fps))), key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()), key=repr)


def test_whole_table_matches_all_pairs(spark, sf001):
    docs = spark.read.parquet(f"{sf001}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(simhash.near_duplicates(docs)) == brute(rows)


def test_odd_rows(spark):
    rng = random.Random(1)
    base = [f"w{rng.randrange(50)}" for _ in range(400)]
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "a b c"), (None, "a b c"), (7, "É é"), (8, "x " * 30000), (8, "x " * 30000)]
    for i in range(40):
        w = list(base)
        w[rng.randrange(400)] = f"z{i}"
        rows.append((100 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'c' as cell", "1 as fp", "2 as component_id")
    assert got(simhash.near_duplicates(df)) == brute(rows)
    assert simhash.near_duplicates(df.where("false")).count() == 0


def test_crowded_cells_lose_no_link(spark):
    rng = random.Random(2)
    centre = rng.getrandbits(64)
    fps = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 4))) for _ in range(400)} | {rng.getrandbits(64) for _ in range(200)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    arr = np.array(signed, np.int64).view(np.uint64)
    for rows in (7, 50, 4096):
        edges = simhash.links(df, 4, rows).collect()
        root = {x: x for x in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in edges:
            assert (np.bitwise_count(np.int64(a ^ b).view(np.uint64))) <= 4
            root[find(a)] = find(b)
        want = {x: x for x in signed}

        def wfind(x):
            while want[x] != x:
                x = want[x]
            return x

        for i, x in enumerate(signed):
            for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= 4):
                want[wfind(x)] = wfind(signed[j])
        parts = lambda f: sorted(sorted(x for x in signed if f(x) == r) for r in {f(x) for x in signed})
        assert parts(find) == parts(wfind)


def test_refined_cells_keep_two_more_shared_blocks():
    rng = random.Random(6)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a ^ sum(1 << x for x in rng.sample(range(64), rng.randrange(0, 5)))
        x, y = (int(simhash.embed(np.array([v], np.uint64))[0]) for v in (a, b))
        shared = [m for m in simhash.block_masks(4) if (x ^ y) & m & (1 << 64) - 1 == 0]
        assert shared
        for m in shared:
            assert any((x ^ y) & f & (1 << 64) - 1 == 0 for f in simhash.finer_masks(m, 4))
            assert all(bin(f & (1 << 64) - 1).count("1") > bin(m & (1 << 64) - 1).count("1") for f in simhash.finer_masks(m, 4))
