"""Every registered core query against its SQL on the same tables."""

import duckdb
import pandas as pd
import pytest

from chronoloom import queries as q

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf0001):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf0001}/{t}.parquet'")
    return con


def canon(df):
    df = df[sorted(df.columns)].astype(object)
    cell = lambda v: None if v is None or (not hasattr(v, "__len__") and pd.isna(v)) else v.item() if hasattr(v, "item") else v
    return list(df.columns), sorted(repr(tuple(float(c) if isinstance(c, (int, float)) and not isinstance(c, bool) else c for c in map(cell, r))) for r in df.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(spark, duck, sf0001, name):
    got = q.QUERIES[name](spark, sf0001).toPandas()
    if name in q.ORACLES:
        assert canon(got) == canon(duck.execute(q.ORACLES[name]).fetchdf())
    else:
        assert len(got.columns) and len(got)


def test_entry_has_stable_schema(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["family", "degree"] and set(e.oracle_sql()) <= set(e.queries())


def test_communities_read_every_edge(spark, duck, sf0001):
    pairs = duck.execute("SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem").fetchall()
    near = {}
    for u, w in pairs:
        near.setdefault(u, {u}).add(w)
        near.setdefault(w, {w}).add(u)
    labels = {x: x for x in near}
    for _ in range(10):
        new = {}
        for x, ys in near.items():
            votes = {}
            for y in ys:
                votes[labels[y]] = votes.get(labels[y], 0) + 1
            new[x] = min(votes, key=lambda c: (-votes[c], c))
        if new == labels:
            break
        labels = new
    groups = {}
    for x, c in labels.items():
        groups.setdefault(c, []).append(x)
    want = sorted((c, len(m), ",".join(sorted(m))) for c, m in groups.items() if len(m) >= 3)
    assert sorted(map(tuple, q.QUERIES["communities"](spark, sf0001).collect())) == want


def test_components_read_every_edge(spark, duck, sf0001):
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for u, w in duck.execute("SELECT DISTINCT 'p' || l_partkey, 's' || l_suppkey FROM lineitem").fetchall():
        a, b = sorted((find(u), find(w)))
        root[b] = a
    want = sorted((x, find(x)) for x in root)
    assert sorted(map(tuple, q.QUERIES["connected_families"](spark, sf0001).select("id", "component").collect())) == want
