"""The modularity search against every partition of small graphs, and on planted groups."""

import random
from itertools import combinations

import pytest

from chronoloom.operators import graph as gr

CLIQUE = lambda ids: list(combinations(ids, 2))


def value(pairs, label):
    pairs = {tuple(sorted(p)) for p in pairs}
    m, ends, inside = len(pairs), {}, 0
    for u, v in pairs:
        inside += label[u] == label[v]
        for x in (u, v):
            ends[label[x]] = ends.get(label[x], 0) + 1
    return inside / m - sum((d / (2 * m)) ** 2 for d in ends.values())


def partitions(ids):
    if not ids:
        yield []
        return
    for rest in partitions(ids[1:]):
        yield [[ids[0]], *rest]
        for i, part in enumerate(rest):
            yield [*rest[:i], [ids[0], *part], *rest[i + 1 :]]


def search(spark, pairs):
    return {r.id: r.community_id for r in gr.modularity_search(spark.createDataFrame(pairs, "u string, v string")).collect()}


@pytest.mark.parametrize("pairs", [CLIQUE("abcd") + CLIQUE("efgh") + [("a", "e")], CLIQUE("abc") + CLIQUE("def") + CLIQUE("gh") + [("c", "d"), ("f", "g")]])
def test_best_of_all_partitions(spark, pairs):
    ids = sorted({x for p in pairs for x in p})
    best = max(value(pairs, {x: i for i, part in enumerate(parts) for x in part}) for parts in partitions(ids))
    got = search(spark, pairs + [pairs[0], pairs[0][::-1]])
    assert set(got) == set(ids) and value(pairs, got) == pytest.approx(best)
    assert all(c == min(x for x in ids if got[x] == c) for c in got.values())


def test_planted_groups_and_odd_edges(spark):
    rng = random.Random(4)
    ids = [f"n{i:03}" for i in range(90)]
    pairs = [(u, v) for u, v in combinations(ids, 2) if rng.random() < (0.4 if int(u[1:]) // 15 == int(v[1:]) // 15 else 0.01)]
    odd = [("n000", "n000"), (None, "n001"), ("alone", "alone"), (None, None)]
    got = search(spark, pairs + odd)
    planted = {x: int(x[1:]) // 15 for x in ids}
    assert "alone" not in got and value(pairs, got) >= 0.98 * value(pairs, planted)
    assert search(spark, odd) == {} and search(spark, pairs) == got
