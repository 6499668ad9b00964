import math

import duckdb
import numpy as np
import pytest

from signalmesh.llm.projection_forest import (LIMIT, ORACLE_SQL, TREES, fit_node, near_vectors, op12_projection_forest, route, split,
                                              unit)
from tests.llm.fixtures import SF2

COLUMNS = "vec_id", "n_links", "component_id", "kept"


def brute(rows, limit=LIMIT):
    """All pairs; rows are ``(vec_id, vector)``."""
    ok = [v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, v in rows]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for dim in {len(v) for (_, v), o in zip(rows, ok) if o}:
        at = [i for i, o in enumerate(ok) if o and len(rows[i][1]) == dim]
        x = unit(np.array([rows[i][1] for i in at], float))
        near = x @ x.T >= limit
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            n[at[a]] += 1
            parent[find(at[a])] = find(at[b])
    low = {}
    for i, (vec_id, _) in enumerate(rows):
        ids = [x for x in (low.get(find(i)), vec_id) if x is not None]
        low[find(i)] = min(ids) if ids else None
    return sorted([(v, n[i], low[find(i)], v == low[find(i)]) for i, (v, _) in enumerate(rows)], key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def families(rng, n, dim, spread):
    """Vectors in families of a few to some hundreds, and many alone."""
    out = []
    while len(out) < n:
        centre = rng.normal(size=dim)
        for _ in range(int(rng.choice([1, 1, 1, 1, 3, 20]))):
            out.append(centre + spread * rng.normal(size=dim))
    return np.array(out[:n])


@pytest.fixture(scope="module")
def crowd():
    rng = np.random.default_rng(5)
    x = families(rng, 4000, 24, 0.16)
    centre = rng.normal(size=24)
    x[:700] = centre + 0.05 * rng.normal(size=(700, 24))  # a crowd of near copies
    walk = rng.normal(size=24)
    for i in range(700, 800):  # a chain, each near the one before it
        walk = walk + 0.2 * rng.normal(size=24)
        x[i] = walk
    x[800:1100] = x[801]  # equal vectors
    return [(int(i), [float(c) for c in v]) for i, v in zip(rng.permutation(len(x)) * 3, x)]


def test_small_leaves_find_nine_tenths_and_nothing_else(spark, crowd):
    want = {r[0]: r for r in brute(crowd)}
    df = spark.createDataFrame(crowd, "vec_id long, embedding array<double>").repartition(6)
    rows = got(near_vectors(df, leaf=64, sample=600))
    links = sum(r[1] for r in want.values())
    assert len(rows) == len(crowd) and all(r[1] <= want[r[0]][1] for r in rows)
    recall = sum(r[1] for r in rows) / links
    whole = sum(r == want[r[0]] for r in rows) / len(rows)
    alone = [r for r in want.values() if r[1]]
    found = sum(min(g[1], 1) for g in rows) / len(alone)
    print("links found", recall, "rows equal", whole, "linked vectors found", found)
    assert recall >= 0.98 and whole >= 0.95 and found >= 0.98
    # one tree alone parts more pairs
    assert sum(r[1] for r in got(near_vectors(df, leaf=64, sample=600, trees=1))) < sum(r[1] for r in rows)


def test_leaves_that_hold_all_are_exact(spark, crowd):
    df = spark.createDataFrame(crowd, "vec_id long, embedding array<double>")
    assert got(near_vectors(df, leaf=3000)) == brute(crowd)


def test_a_crowd_in_tiles_is_exact(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=16) + 0.03 * rng.normal(size=(500, 16))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(near_vectors(df, leaf=40, trees=2)) == brute(rows)


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF2}/embeddings.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL})").fetchall(), key=repr)
    assert got(op12_projection_forest(spark, SF2)) == want


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [2.0, 0.0]), (None, [1.0, 0.01]), (None, [-1.0, 0.0]), (3, None), (4, []), (5, [0.0, 0.0]),
            (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.01, 0.0]), (11, [-0.0, 1.0]), (12, [0.0, 1.0]),
            (13, [1e200, 1e200]), (14, [1e-200, 1e-200]), (None, None)]
    df = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "vec_id long, embedding array<double>, node int, size int, component string").coalesce(2)
    assert got(near_vectors(df)) == brute(rows)
    assert near_vectors(df.limit(0)).count() == 0


def test_routing_meets_the_fitted_tree():
    rng = np.random.default_rng(7)
    x = unit(rng.normal(size=(900, 8)))
    splits = {p: (t, d) for p, t, d in fit_node(x, 1, 1, 50, 0.02)}
    leaves = list(route(x, 1, 1, splits, 0.02))
    assert all(len(rows) <= 50 or dense for _, dense, rows in leaves)
    assert set(np.concatenate([rows for *_, rows in leaves])) == set(range(900))
    assert split(np.zeros(100), 0.01) is None and abs(split(np.r_[np.zeros(60), np.linspace(1, 2, 40)], 0.01)) < 1.3


def test_trees_differ():
    from signalmesh.llm.projection_forest import directions

    assert len({tuple(directions(t, 3, 8)) for t in range(TREES)}) == TREES
