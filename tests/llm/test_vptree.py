import numpy as np
import pytest

from signalmesh.llm.vptree import nearest, op3_vp_tree
from tests.llm.fixtures import SF2


def brute(rows, queries, k=20):
    out = {}
    for q, v in queries.items():
        scored = sorted((-float(np.dot(np.array(v, dtype=float), np.array(x, dtype=float))), i) for i, x in rows if i != q and len(x) == len(v))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def test_query_is_exact(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF2}/embeddings.parquet").collect()]
    want = brute(rows, {i: v for i, v in rows if i % 20 == 0})
    got = {}
    for r in sorted(op3_vp_tree(spark, SF2).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_ties_norms_and_odd_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.integers(-3, 4, 3)]) for i in range(400)] + [(i, [1.0, 2.0, 3.0]) for i in range(400, 600)]
    odd = [(600, None), (601, []), (602, [0.0, 0.0, 0.0]), (603, [1.0, None, 1.0]), (604, [float("nan"), 1.0, 1.0]), (605, [float("inf"), 1.0, 1.0]),
           (None, [1.0, 1.0, 1.0]), (620, [1.0, 1.0]), (640, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows + odd], "vec_id long, embedding array<float>, vector string, rank int")
    usable = [(i, v) for i, v in rows if any(v)] + odd[-2:]
    want = brute(usable, {i: v for i, v in usable if i % 20 == 0})
    for shard_rows, block_rows in ((4096, 4096), (100, 7)):
        got = {}
        for r in sorted(nearest(df, df.filter("vec_id % 20 = 0"), shard_rows=shard_rows, block_rows=block_rows).collect(), key=lambda r: r["rank"]):
            got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert got == {q: w for q, w in want.items() if w}
    assert nearest(df.limit(0), df.limit(0)).count() == 0


def test_repeated_ids_take_no_place(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(i, [x * 3 for x in v]) for i, v in rows[::20] for _ in range(3)] + rows[::20] * 2  # other vectors of a query's id, and equal rows
    rows += [(i, [x * 3 for x in v]) for i, v in rows[1:2] * 2]
    rows += [(i, [2.0, 2.0, 2.0]) for i in [80] * 30 + [81, 82, 80, 79]]  # a vector shared by a query's many rows and others
    rows += [(i, v) for i, v in ((100, [5.0, 0.0, 0.0]), (999, [5.0, 0.0, 0.0]), (200, [5.0, 1.0, 0.0]))]  # ties
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    asks = {}
    for i, v in rows:
        if i % 20 == 0:
            asks[i] = min(asks.get(i, v), v)
    for k in (1, 3, 20):
        want = brute(rows, asks, k)
        for shard_rows in (4096, 30):
            got = {}
            for r in sorted(nearest(df, df.filter("vec_id % 20 = 0"), k=k, shard_rows=shard_rows).collect(), key=lambda r: r["rank"]):
                got.setdefault(r.query_id, []).append((r.vec_id, r.score))
            assert got.keys() == want.keys()
            for q in want:
                assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
                assert [s for _, s in got[q]] == pytest.approx([s for _, s in want[q]])


def test_smaller_factor_looks_at_less_and_recalls_nine_tenths():
    from signalmesh.llm.vptree import Search, Tree

    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    x = centres[rng.integers(40, size=4000)] + 0.25 * rng.normal(size=(4000, 16))
    tree, q = Tree(x), x[::20]
    own, ids = np.arange(0, 4000, 20), np.arange(4000)
    exact = Search(tree, q, own, ids, 20, 1.0)
    near = Search(tree, q, own, ids, 20, 0.8)
    want = np.argsort(np.where(np.arange(4000) == own[:, None], -np.inf, q @ x.T) * -1, axis=1)[:, :20]
    assert (np.sort(exact.found, 1) == np.sort(want, 1)).all()
    recall = np.mean([len(set(a) & set(b)) / 20 for a, b in zip(near.found, want)])
    assert near.looked < exact.looked < 200 * 4000 and recall >= 0.9
