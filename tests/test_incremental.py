"""Refreshes against a full recompute, traversals against plain searches."""

import datetime as dt
import random

import pytest

from chronoloom.operators import graph, incremental, traversal
from chronoloom.operators.graph import redirect_closure

DAY = lambda n: dt.datetime(2024, 1, 1) + dt.timedelta(days=n)
ROW = "id string, family_id string, processed_time timestamp, invalid_at timestamp"


def tables(spark, seed, families=8, days=12):
    r = random.Random(seed)
    ents = [(f"e{i}", f"f{r.randrange(families)}", DAY(r.randrange(days)), DAY(r.randrange(3, days)) if r.random() < 0.4 else None) for i in range(40)]
    rels = [(f"r{i}", f"g{r.randrange(20)}", DAY(r.randrange(days)), DAY(r.randrange(3, days)) if r.random() < 0.3 else None, f"e{r.randrange(42)}", f"e{r.randrange(40)}", r.choice("xyz")) for i in range(60)]
    return spark.createDataFrame(ents, ROW), spark.createDataFrame(rels, ROW + ", entity1_id string, entity2_id string, content string")


def rows(df):
    return sorted(map(tuple, df.select(*incremental.EDGE).collect()))


@pytest.mark.parametrize("seed", range(4))
def test_edges_after_appends_invalidations_and_merges(spark, seed):
    ents, rels = tables(spark, seed)
    was = spark.createDataFrame([("f1", "f2", DAY(1))], "source_family_id string, target_family_id string, updated_at timestamp")
    more = spark.createDataFrame([("f1", "f2", DAY(1)), ("f2", "f3", DAY(6)), ("f5", "f4", DAY(6))], was.schema)
    old_moves, moves = redirect_closure(was), redirect_closure(more)
    old = incremental.current_edges(incremental.known_at(rels, "2024-01-06"), incremental.known_at(ents, "2024-01-06"), old_moves)
    now = [incremental.known_at(x, "2024-01-09") for x in (rels, ents)]
    changed = [incremental.feed(x, "2024-01-06", "2024-01-09") for x in (rels, ents)]
    fresh = more.where("updated_at > '2024-01-06'")
    delta = incremental.refresh_edges(old, *now, *changed, moves, fresh)
    full = incremental.current_edges(*now, moves)
    assert rows(incremental.applied(old, delta, "relation_id")) == rows(full)
    again = incremental.refresh_edges(full, *now, *[x.where("false") for x in changed], moves, fresh.where("false"))
    assert again.count() == 0


def test_a_small_change_touches_few_rows(spark):
    n = 400
    ents = spark.createDataFrame([(f"e{i}", f"f{i}", DAY(0), None) for i in range(n)] + [("new", "f7", DAY(5), None)], ROW)
    rels = spark.createDataFrame([(f"r{i}", f"g{i}", DAY(0), None, f"e{i}", f"e{(i + 1) % n}", "x") for i in range(n)], ROW + ", entity1_id string, entity2_id string, content string")
    old = incremental.current_edges(rels, incremental.known_at(ents, "2024-01-02"))
    delta = incremental.refresh_edges(old, rels, ents, rels.where("false"), ents.where("id = 'new'"))
    assert {(r.op, r.relation_id) for r in delta.collect()} == {(op, r) for op in ("delete", "insert") for r in ("r6", "r7")}


def test_newest_versions(spark):
    ents, _ = tables(spark, 11)
    a, b = (incremental.known_at(ents, t) for t in ("2024-01-05", "2024-01-09"))
    newest = lambda x: incremental.latest(x.where("invalid_at is null")).select("family_id", "id")
    delta = incremental.refresh_newest(newest(a), incremental.feed(ents, "2024-01-05", "2024-01-09"), b)
    assert set(map(tuple, incremental.applied(newest(a), delta, "id").collect())) == set(map(tuple, newest(b).collect()))


def concepts(spark, seed):
    r = random.Random(seed)
    pick = lambda: (DAY(r.randrange(4)) if r.random() < 0.5 else None, DAY(r.randrange(4, 9)) if r.random() < 0.4 else None)
    out = [(f"e{i}", f"f{r.randrange(9)}", "entity", None, DAY(i % 5), *pick(), None) for i in range(20)]
    for i in range(30):
        odd = '{"tier":"candidate","status":"hypothesized"}' if r.random() < 0.15 else None
        out.append((f"r{i}", f"g{r.randrange(22)}", "relation", [f"e{r.randrange(22)}", f"e{r.randrange(20)}"], DAY(i % 5), *pick(), odd))
    out += [(f"o{i}", f"h{i % 4}", "observation", None, DAY(i % 5), *pick(), None) for i in range(8)]
    told = [(f"o{r.randrange(8)}", r.choice([f"e{r.randrange(20)}", f"r{r.randrange(30)}", "x"])) for _ in range(20)]
    return out, told


def plain_walk(rows_, told, t, starts, costs, most):
    ok = [x for x in rows_ if (x[5] is None or x[5] <= t) and (x[6] is None or x[6] > t)]
    now = {}
    for x in ok:
        if x[1] not in now or (x[4], x[0]) > (now[x[1]][4], now[x[1]][0]):
            now[x[1]] = x
    now = {f: x for f, x in now.items() if not x[7]}
    family = {x[0]: x[1] for x in rows_ if x[2] != "observation"}

    def near(f):
        x = now[f]
        if x[2] == "entity":
            return {g for g, y in now.items() if y[2] == "relation" and any(family.get(e) == f for e in y[3])}
        ends = x[3] if x[2] == "relation" else [target for o, target in told if o == x[0]]
        found = {family[e] for e in ends if family.get(e) in now}
        return {g for g in found if now[g][2] == "entity"} if x[2] == "relation" else found

    best = {s: 0 for s in starts if s in now}
    todo = list(best)
    while todo:
        f = todo.pop()
        for g in near(f):
            c = best[f] + costs[now[g][2]]
            if c <= most and c < best.get(g, most + 1):
                best[g] = c
                todo.append(g)
    return {(f, now[f][0], now[f][2], c) for f, c in best.items()}


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("costs", [{"entity": 1, "relation": 1, "observation": 1}, {"entity": 1, "relation": 0, "observation": 2}])
def test_traversal_at_a_time(spark, seed, costs):
    data, told = concepts(spark, seed)
    df = spark.createDataFrame(data, "id string, family_id string, role string, connects array<string>, processed_time timestamp, valid_at timestamp, invalid_at timestamp, attributes string")
    mentions = spark.createDataFrame(told, "episode_id string, target_id string")
    starts = ["f1", "g3", "h0", "h1", "nobody"]
    steps = traversal.steps(df, mentions, "2024-01-04", costs)
    got = traversal.traverse(steps, spark.createDataFrame([(s,) for s in starts], "family_id string"), 3)
    assert {tuple(r) for r in got.collect()} == plain_walk(data, told, DAY(3), starts, costs, 3)
    assert {r.family_id for r in traversal.crossed(steps, got, 3).collect()} >= {r.family_id for r in got.where("role = 'relation'").collect()}


@pytest.mark.parametrize("seed", range(3))
def test_paths_from_both_ends(spark, seed):
    r = random.Random(seed)
    pairs = {(f"n{a:02d}", f"n{b:02d}") for a, b in ((r.randrange(14), r.randrange(14)) for _ in range(20))}
    edges = spark.createDataFrame(sorted(pairs) * 2, "u string, v string")
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    ways = [["n00"]]
    while ways and not any(w[-1] == "n05" for w in ways) and len(ways[0]) <= 6:
        ways = [[*w, x] for w in ways for x in near.get(w[-1], ()) if x not in w]
    want = sorted(w for w in ways if w[-1] == "n05")[:3]
    got = [list(x.path) for x in graph.shortest_paths(edges, "n00", "n05", 6, 3).collect()]
    assert got == want
    assert [list(x.path) for x in graph.shortest_paths(edges, "n00", "n00", 6, 3).collect()] == [["n00"]]
