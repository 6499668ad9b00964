"""Operator 12: near-duplicate embeddings by a forest of random-projection trees.

Equal vectors are one class first, so copies of any number cost as one vector.
A tree parts the classes at random projections: all nodes of a level share one
random direction, and a node's threshold is the place of its middle part where
the two sides cause the least comparing.  Sides overlap: vectors within
``spill`` of the threshold go to both, in units of how far apart a pair at the
similarity limit lies along a random direction, so a linked pair is seldom
parted.  ``trees`` trees with other directions make up for the pairs one tree
parts.  Vectors are compared within leaves, every pair above the limit in double
precision, and links of all trees are joined to components.

Thresholds are fitted to at most ``sample`` vectors a node (chosen by hash),
all vectors are routed by them, and nodes that still hold more than two leaves'
vectors are parted again in the next round, so trees grow with the data while
no task sees more than a sample.  A node that no threshold parts (a crowd of near copies,
all within the overlap) becomes a leaf of any size, whose vectors are
compared in tiles of bounded size, all of them.

Leaves return no pairs.  Each vector carries the numbers of all its leaves; a
pair counts in the first leaf that both share, so a leaf returns each vector's
number of new links, and ties each vector to the smallest one it reaches in the
leaf.

Defined results: vectors that are null, empty, zero, or hold null or non-finite components
link with nothing; vectors of different lengths are never linked; rows
that repeat a ``vec_id`` are vectors each; null ids are never a component's smallest unless all are null
(then ``component_id`` is null); an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import RID, ship, table, with_rid, written
from signalmesh.llm.near_dedup import components

LIMIT, TREES, LEAF = 0.95, 6, 768
#: Overlap on either side of a threshold, in standard deviations of a limit pair's distance along a random direction.
SPILL = 0.3
SAMPLE = 16_384
#: Vectors of a node that a task routes at once.
SHARE = 32_768
#: Sampled vectors a fitted node keeps, and levels of a tree (its place is a number of 56 bits).
LEAST_SAMPLE, DEEPEST = 48, 52
#: A split must cut the comparing below this share.
WORTH = 0.9
TREE_SHIFT = 56
CANDIDATES = np.linspace(0.1, 0.9, 33)

FIT = pa.schema([("dim", pa.int32()), ("node", pa.int64()), ("total", pa.int64()), ("place", pa.int64()), ("threshold", pa.float64()),
                 ("dense", pa.bool_())])
FIT_SQL = "dim int, node long, total long, place long, threshold double, dense boolean"
ROUTED = pa.schema([("vec", pa.int64()), ("dim", pa.int32()), ("node", pa.int64()), ("dense", pa.bool_())])
FOUND = pa.schema([("vec", pa.int64()), ("n", pa.int64()), ("low", pa.int64())])


def directions(tree: int, level: int, dim: int) -> np.ndarray:
    """The unit direction of a tree's level."""
    v = np.random.default_rng((12, tree, level, dim)).normal(size=dim)
    return v / np.linalg.norm(v)


def depth_of(place: int) -> int:
    """Level of a node: its place is a one, then a bit for every side taken."""
    return place.bit_length() - 1


def margin(dim: int, limit: float, spill: float) -> float:
    return spill * math.sqrt(max(2 - 2 * limit, 0) / dim)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled by their largest component first, so that no square passes the range of doubles."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def split(at: np.ndarray, overlap: float) -> float | None:
    """The threshold for projections ``at`` that leaves the least comparing on both sides, if any is worth it."""
    n = len(at)
    at = np.sort(at)
    places = np.minimum((CANDIDATES * n).astype(int), n - 1)
    cuts = at[places]
    left = np.searchsorted(at, cuts + overlap, side="right")
    right = n - np.searchsorted(at, cuts - overlap, side="left")
    work = (left.astype(float) ** 2 + right.astype(float) ** 2) / n ** 2
    best = int(np.argmin(work))
    return float(cuts[best]) if work[best] < WORTH else None


def fit_node(x: np.ndarray, tree: int, place: int, leaf: float, overlap: float) -> Iterator[tuple[int, float, bool]]:
    """``place, threshold, dense`` of a node's splits and dense leaves below it, fitted to unit vectors ``x``; leaves of up to ``leaf``."""
    todo = [(place, np.arange(len(x)))]
    projected: dict[int, np.ndarray] = {}
    while todo:
        here, rows = todo.pop()
        level = depth_of(here)
        if len(rows) <= leaf:
            if here == place:  # the sample came out small: nothing to part by
                yield here, math.nan, True
            continue
        if level not in projected:
            projected[level] = x @ directions(tree, level, x.shape[1])
        p = projected[level][rows]
        threshold = split(p, overlap) if level < DEEPEST else None
        if threshold is None:
            yield here, math.nan, True
            continue
        yield here, threshold, False
        todo.append((2 * here, rows[p <= threshold + overlap]))
        todo.append((2 * here + 1, rows[p >= threshold - overlap]))


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _fit(t: pa.Table, leaf: int, limit: float, spill: float) -> pa.Table:
    """Splits of one node from its sample; ``total`` is how many vectors it has."""
    dim, node, total = t["dim"][0].as_py(), t["node"][0].as_py(), t["total"][0].as_py()
    order = np.argsort(t["vec"].to_numpy())
    x = unit(_matrix(t["vector"], dim))[order]
    tree, place = node >> TREE_SHIFT, node & ((1 << TREE_SHIFT) - 1)
    small = max(leaf * len(x) / total, min(LEAST_SAMPLE, len(x) - 1))
    rows = list(fit_node(x, tree, place, small, margin(dim, limit, spill)))
    columns = [[dim] * len(rows), [node] * len(rows), [total] * len(rows), *zip(*rows)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FIT)], schema=FIT)


def route(x: np.ndarray, tree: int, place: int, splits: dict[int, tuple[float, bool]], overlap: float) -> Iterator[tuple[int, bool, np.ndarray]]:
    """``place, dense, rows`` of the leaves that unit vectors ``x`` reach from a node."""
    todo = [(place, np.arange(len(x)))]
    projected: dict[int, np.ndarray] = {}
    while todo:
        here, rows = todo.pop()
        if not len(rows):
            continue
        threshold, dense = splits.get(here, (math.nan, False))
        if here not in splits or dense:
            yield here, dense, rows
            continue
        level = depth_of(here)
        if level not in projected:
            projected[level] = x @ directions(tree, level, x.shape[1])
        p = projected[level][rows]
        todo.append((2 * here, rows[p <= threshold + overlap]))
        todo.append((2 * here + 1, rows[p >= threshold - overlap]))


def _routed(t: pa.Table, splits: pa.Table, limit: float, spill: float) -> pa.Table:
    """The leaves that a share of a node's vectors reach."""
    dim, node, vecs = t["dim"][0].as_py(), t["node"][0].as_py(), t["vec"].to_numpy()
    fitted = {s["place"]: (s["threshold"], s["dense"]) for s in splits.to_pylist()}
    tree, place = node >> TREE_SHIFT, node & ((1 << TREE_SHIFT) - 1)
    out = [pa.RecordBatch.from_arrays([pa.array(vecs[rows]), pa.array(np.full(len(rows), dim, np.int32)),
                                       pa.array(np.full(len(rows), tree << TREE_SHIFT | here, np.int64)), pa.array(np.full(len(rows), dense))], schema=ROUTED)
           for here, dense, rows in route(unit(_matrix(t["vector"], dim)), tree, place, fitted, margin(dim, limit, spill))]
    return pa.Table.from_batches(out, schema=ROUTED)


def _reached(near: np.ndarray) -> np.ndarray:
    """Each row's smallest row of its component in a square matrix of links."""
    low = np.full(len(near), -1)
    for i in range(len(near)):
        if low[i] < 0:
            here, front = np.zeros(len(near), bool), np.zeros(len(near), bool)
            front[i] = True
            while front.any():
                here |= front
                front = near[front].any(axis=0) & ~here
            low[here] = i
    return low


def compare_tile(t: pa.Table, limit: float) -> pa.Table:
    """New links of the vectors of one tile (``i`` = ``j``: among themselves, else between the two blocks), and what each reaches."""
    vecs, block, size = t["vec"].to_numpy(), t["block"].to_numpy(), t["size"].to_numpy()
    order = np.argsort(vecs)
    vecs, block, size = vecs[order], block[order], size[order]
    node, i, j = t["node"][0].as_py(), t["i"][0].as_py(), t["j"][0].as_py()
    x = unit(_matrix(t["vector"], t["dim"][0].as_py()))[order]
    near = x @ x.T >= limit
    np.fill_diagonal(near, False)
    if i != j:
        near &= block[:, None] != block
    linked = np.flatnonzero(near.any(axis=1))
    if not len(linked):
        return FOUND.empty_table()
    near = near[np.ix_(linked, linked)]
    low = vecs[linked][_reached(near)]
    # leaves before this one that the linked vectors have, as a table of vectors by leaves
    before = [[x for x in held if x < node] for held in (t["leaves"][int(k)].as_py() for k in order[linked])]
    number = {x: k for k, x in enumerate(sorted({x for held in before for x in held}))}
    if number:
        has = np.zeros((len(linked), len(number)), np.float32)
        for k, held in enumerate(before):
            has[k, [number[x] for x in held]] = 1
        near &= has @ has.T == 0
    new = near.astype(np.int64) @ size[linked]
    return pa.Table.from_arrays([pa.array(vecs[linked]), pa.array(new), pa.array(low)], schema=FOUND)


def forest(classes: DataFrame, limit: float = LIMIT, trees: int = TREES, leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """``vec, dim, node, dense``: the leaves of all trees that each vector of ``vec, dim, vector`` reaches."""
    tops = [t << TREE_SHIFT | 1 for t in range(trees)]
    # the trunk: every vector is at the top of every tree
    at = classes.select("vec", "dim", F.explode(F.array(*map(F.lit, tops))).alias("node"), F.lit(False).alias("dense"))
    done = None
    while True:
        sizes = written(at.groupBy("dim", "node").agg(F.count("*").alias("total"), F.max("dense").alias("dense")), "forest-sizes")
        large = sizes.filter((F.col("total") > 2 * leaf) & ~F.col("dense")).select("dim", "node", "total")
        ready = at.join(large.select("dim", "node"), ["dim", "node"], "left_anti")
        done = ready if done is None else done.unionByName(ready)
        if large.isEmpty():
            return done.select("vec", "dim", "node", "dense")
        held = at.select("vec", "dim", "node").join(large, ["dim", "node"])
        vectors = classes.select("vec", "vector")
        share = F.pmod(F.xxhash64("vec", "node"), F.lit(1 << 30)) < F.least(F.lit(sample) / F.col("total"), F.lit(1.0)) * (1 << 30)
        picked = held.filter(share).join(vectors, "vec")
        splits = written(picked.groupBy("dim", "node").applyInArrow(lambda t: _fit(t, leaf, limit, spill), FIT_SQL), "forest-splits")
        # a node's vectors are dealt to shares of bounded size, each with the node's splits
        shares = F.ceil(F.col("total") / SHARE)
        vectors = held.withColumn("share", F.pmod(F.xxhash64("vec", F.lit("share")), shares)).join(vectors, "vec").select("vec", "dim", "node", "share", "vector")
        dealt = splits.withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)))
        at = written(vectors.groupBy("dim", "node", "share").cogroup(dealt.groupBy("dim", "node", "share"))
                     .applyInArrow(lambda t, s: _routed(t, s, limit, spill), "vec long, dim int, node long, dense boolean"), "forest-nodes")


def near_vectors(vectors: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", limit: float = LIMIT, trees: int = TREES,
                 leaf: int = LEAF, spill: float = SPILL, sample: int = SAMPLE) -> DataFrame:
    """One row per input row: row number, ``vec_id, n_links, component, component_id, kept``."""
    ship(vectors.sparkSession)
    v = F.col("vector")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    usable = F.coalesce((F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))
    kind = "array<float>" if dict(vectors.dtypes)[vector] == "array<float>" else "array<double>"
    points = written(with_rid(vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vector"))
                              .withColumn("vector", F.when(usable, v))), "forest-points")
    classes = written(points.filter("vector is not null").groupBy("vector")
                      .agg(F.min(RID).alias("vec"), F.count("*").alias("size"), F.min("vec_id").alias("first"))
                      .withColumn("dim", F.size("vector")), "forest-classes")
    leaves = written(forest(classes.select("vec", "dim", "vector"), limit, trees, leaf, spill, sample), "forest-leaves")
    # a leaf is one tile, or tiles of two blocks each
    n = F.count("*")
    blocks = leaves.groupBy("dim", "node").agg(F.when(n > 2 * leaf, F.ceil(n / leaf)).otherwise(1).cast("long").alias("blocks"))
    tiles = (leaves.join(blocks, ["dim", "node"]).withColumn("block", F.pmod(F.xxhash64("vec"), F.col("blocks")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
             .select("vec", "node", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"))
    mine = leaves.groupBy("vec").agg(F.collect_list("node").alias("leaves"))
    dealt = tiles.join(classes.select("vec", "dim", "vector", "size").join(mine, "vec"), "vec")
    found = written(dealt.groupBy("dim", "node", "i", "j").applyInArrow(lambda t: compare_tile(t, limit), "vec long, n long, low long"), "forest-found")
    counts = found.groupBy("vec").agg(F.sum("n").alias("n"))
    linked = components(found.select(F.col("vec").alias("a"), F.col("low").alias("b")))
    grouped = (classes.select("vec", "vector", "size", "first").join(counts, "vec", "left")
               .join(linked.withColumnRenamed("node", "vec"), "vec", "left")
               .select("vector", "first", (F.coalesce("n", F.lit(0)) + F.col("size") - 1).alias("n_links"),
                       F.coalesce("component", "vec").alias("component")))
    grouped = written(grouped, "forest-grouped")
    smallest = grouped.groupBy("component").agg(F.min("first").alias("component_id"))
    told = grouped.join(smallest, "component").select("vector", "n_links", "component", "component_id")
    near = points.filter("vector is not null").join(told, "vector").select(RID, "vec_id", "n_links", "component", "component_id")
    alone = points.filter("vector is null").select(RID, "vec_id", F.lit(0).cast("long").alias("n_links"), F.col(RID).alias("component"),
                                                   F.col("vec_id").alias("component_id"))
    return near.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def op12_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``embeddings``."""
    return near_vectors(table(spark, sf_dir, "embeddings")).drop(RID, "component")


#: The same in DuckDB, over all pairs.
ORACLE_SQL = """
WITH RECURSIVE e AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id
          WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM e UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n_links FROM links GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM low LEFT JOIN n USING (vec_id)
"""
