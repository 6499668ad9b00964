"""Operator 8: near-duplicates by a multi-index Hamming join over b-bit min-hash signatures.

A document's signature is ``HASHES`` min-hashes of its distinct five-word
shingles, each cut to 16 bits; the distance of two signatures is the number of
hashes in which they differ: 24 of 96 on average at similarity 0.75, with a
standard deviation of 4.2.  The signature is split into 16 chunks of 6 hashes.
By the pigeonhole principle two signatures at most ``GUARANTEED`` = 31 apart
have a chunk with at most one error, so a document is indexed under every chunk
with every single hash left out (96 keys), and *all* pairs within that distance
share a key.  Pairs further apart share one nearly always (at similarity 0.75
all but 5 in a million do), so shared keys are followed up to ``RADIUS``, five
deviations above the average.

Texts with equal shingle sets are first merged to one class (grouping by a
128-bit digest of the set), which copies of any number cannot overload.  Keys
with one class are dropped.  Under the others, not all pairs become rows.  First
the smallest class of a key (its hub) meets the others: pairs whose signatures
are within the radius are confirmed on their full shingle sets, and classes
connected so far get a common label.  Pairs that have one label need no test, so
a key of thousands of near copies is done after its hub.  Classes of keys that
still hold several labels are then compared in tiles: their full sets meet in
blocks bounded by rows and bytes, a pair of blocks a task, which counts common
shingles by matrix products and returns a spanning forest of the links it finds.
Where keys overlap so much that their pairs outnumber those of all their classes
together, the classes are compared as one group and no pair twice.  Links that
are left out so lie within one component; no component is lost.

Components come from alternating large-star and small-star steps.
Each step's tables are written to the shared checkpoint folder.

Defined results: null, empty and blank texts have no shingles and are alone;
texts with fewer than five words are one shingle; rows repeating a doc_id are
separate rows; null doc_ids are never a component's smallest unless all are null
(then ``component_id`` is null); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import RID, documents, flushed, given_back, identified, keep_rows, numbered, table, written
from signalmesh.session import only_result

WORDS, PERCENT = 5, 75
HASHES, CHUNK, GUARANTEED, RADIUS = 96, 6, 31, 46
#: Words whose hashes a worker keeps (a memory bound only).
CACHED = 400_000
#: Shingles hashed together.
BLOCK = 4096
#: A block's classes and bytes of shingles on average (a memory bound only: a group has as many blocks as it needs).
TILE_ROWS, TILE_BYTES = 1000, 4 << 20
#: Shingles of at least this many of a tile's sets are counted by matrix products, that many columns at once.
DENSE, COLUMNS = 16, 1024

SIGNATURES = pa.schema([(RID, pa.int64()), ("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("signature", pa.binary())])
SETS = pa.schema([("node", pa.int64()), ("shingles", pa.binary())])
KEYS = pa.schema([("key", pa.int64()), ("node", pa.int64())])
MIX = np.random.default_rng(8).integers(1, 1 << 63, (2, HASHES), dtype=np.uint64) | np.uint64(1)
STEPS = np.random.default_rng(5).integers(1, 1 << 63, 16, dtype=np.uint64) | np.uint64(1)


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > CACHED:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(maxsize=1)
def _word_hashes() -> _WordHashes:
    return _WordHashes()


def _stir(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of a text."""
    # bytes.lower() and bytes.split() know A-Z and the six white-space bytes only, as the contract does
    tokens = text.encode().lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    h = _stir(np.fromiter(map(_word_hashes().__getitem__, tokens), np.uint64, len(tokens)))
    width = min(words, len(h))
    total = np.zeros(len(h) - width + 1, np.uint64)
    for k in range(width):
        total = _stir(total + STEPS[k % len(STEPS)]) + h[k: len(h) - width + 1 + k] * STEPS[(k + 7) % len(STEPS)]
    return np.unique(_stir(total + np.uint64(width)))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The min-hashes, cut to 16 bits."""
    low = np.full(HASHES, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), BLOCK):
        x = shingles[at: at + BLOCK, None] * MIX[0] + MIX[1]
        np.minimum(low, x.min(axis=0), out=low)
    return (_stir(low) >> np.uint64(48)).astype("<u2")


def _sign(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for rid, doc_id, text in documents(batches, RID, "doc_id", "text"):
            s = shingle_set(text, words)
            if len(s):
                yield rid, doc_id, len(s), xxhash.xxh3_128_digest(s.tobytes()), signature(s).tobytes()
            else:
                yield rid, doc_id, 0, None, None

    yield from given_back(flushed(rows(), SIGNATURES), _word_hashes())


def _set_rows(batches: Iterable[pa.RecordBatch], words: int) -> Iterator[pa.RecordBatch]:
    sets = ((node, shingle_set(text, words).astype("<u8").tobytes()) for node, text in documents(batches, "node", "text"))
    yield from given_back(flushed(sets, SETS, weigh=lambda r: len(r[1])), _word_hashes())


def index_keys(signatures: np.ndarray) -> np.ndarray:
    """Each signature's keys: a hash of the chunk, the place left out, and the chunk's other hashes."""
    chunks = signatures.reshape(len(signatures), -1, CHUNK).astype(np.uint64)
    out = []
    for left_out in range(CHUNK):
        key = np.broadcast_to(np.arange(chunks.shape[1], dtype=np.uint64) * np.uint64(CHUNK) + np.uint64(left_out), chunks.shape[:2])
        for k in range(CHUNK):
            if k != left_out:
                key = _stir(key + STEPS[k]) + chunks[:, :, k] * STEPS[k + CHUNK]
        out.append(_stir(key).astype(np.int64))
    return np.concatenate(out, axis=1)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(len(column), HASHES)


def _index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 2000):
            part = batch.slice(at, 2000)
            keys = index_keys(_signatures(part["signature"]))
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(part["node"].to_numpy(), keys.shape[1]))], schema=KEYS)


def _within(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose signatures are within the radius."""
    for batch in batches:
        if batch.num_rows:
            apart = (_signatures(batch["a_sig"]) != _signatures(batch["b_sig"])).sum(axis=1)
            near = pa.array(apart <= RADIUS)
            yield pa.RecordBatch.from_arrays([batch["a"].filter(near), batch["b"].filter(near)], names=["a", "b"])


def _confirmed(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Pairs whose full shingle sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def rows():
        for a, b, x, y in documents(batches, "a", "b", "a_set", "b_set"):
            x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
            common = len(np.intersect1d(x, y, assume_unique=True))
            if 100 * common >= percent * (len(x) + len(y) - common):
                yield a, b

    yield from flushed(rows(), schema)


def components(links: DataFrame) -> DataFrame:
    """``node, component`` (its smallest node) of all linked nodes. ``links``: ``a, b``.

    Large-star ties a node's larger neighbours to its smallest one, small-star
    its smaller ones; every step is a grouping with map-side minima, so that a
    hub's links meet as one minimum a task.
    """
    edges = written(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).filter("u < v").distinct(), "star")
    mark = lambda df: df.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 31))).first()
    last = mark(edges)
    while last[0]:
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("m")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("m")))
        low = both.groupBy("n").agg(F.min("m").alias("m")).select("n", F.least("n", "m").alias("low"))
        large = both.join(low, "n").filter("m > n").select(F.col("low").alias("u"), F.col("m").alias("v"))
        large = written(large.filter("u < v").distinct(), "star")
        small = large.join(large.groupBy("v").agg(F.min("u").alias("low")), "v")
        small = small.select(F.col("low").alias("u"), F.explode(F.array("u", "v")).alias("v")).filter("u < v").distinct()
        edges = written(small, "star")
        now = mark(edges)
        if now == last:  # the same edges: every node hangs on its component's smallest
            break
        last = now
    return edges.select(F.col("v").alias("node"), F.col("u").alias("component")).unionByName(
        edges.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())


def _tested(pairs: DataFrame, classes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of classes that are linked: sizes, then signatures, then full sets."""
    side = lambda x: classes.select(F.col("node").alias(x), F.col("n").alias(f"{x}_n"), F.col("signature").alias(f"{x}_sig"))
    near = (pairs.join(side("a"), "a").join(side("b"), "b")
            .filter(F.least("a_n", "b_n") * 100 >= F.greatest("a_n", "b_n") * percent)
            .select("a", "b", "a_sig", "b_sig").mapInArrow(_within, "a long, b long"))
    near = written(near, "near-pairs")
    full = lambda x: sets.select(F.col("node").alias(x), F.col("shingles").alias(f"{x}_set"))
    return written(near.join(full("a"), "a").join(full("b"), "b").mapInArrow(lambda b: _confirmed(b, percent), "a long, b long"), "near-links")


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many elements each two of the sets share (a square matrix; sets are sorted and have no repeats)."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(x) for x in sets])
    values = np.concatenate(sets)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    starts = np.flatnonzero(np.r_[True, values[1:] != values[:-1]])
    degree = np.diff(np.r_[starts, len(values)])
    common = np.zeros((n, n), np.float32)
    for d in range(2, DENSE):
        members = owner[starts[degree == d][:, None] + np.arange(d)]
        for x in range(d):
            for y in range(x + 1, d):
                common += np.bincount(members[:, x] * n + members[:, y], minlength=n * n).reshape(n, n) if len(members) else 0
    common += common.T
    many = np.flatnonzero(degree >= DENSE)
    for at in range(0, len(many), COLUMNS):
        part = many[at: at + COLUMNS]
        hold = np.zeros((n, len(part)), np.float32)
        rows = np.concatenate([owner[starts[c]: starts[c] + degree[c]] for c in part])
        hold[rows, np.repeat(np.arange(len(part)), degree[part])] = 1
        common += hold @ hold.T
    return common


def forest(linked: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of a graph given by its square matrix."""
    seen = np.zeros(len(linked), bool)
    for root in range(len(linked)):
        todo = [] if seen[root] else [root]
        seen[root] = True
        while todo:
            at = todo.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new] = True
            todo.extend(new.tolist())
            yield from ((at, x) for x in new.tolist())


def _tile(t: pa.Table, percent: int) -> pa.Table:
    """Labels that a tile's links join: all pairs of one block, or those across two."""
    label, block = t["label"].to_numpy(), t["block"].to_numpy()
    a, b = [], []
    if (label != label[0]).any():
        sets = [np.frombuffer(x, "<u8") for x in t["shingles"].to_pylist()]
        size, common = np.array([len(x) for x in sets], np.int64), common_counts(sets).astype(np.int64)
        linked = 100 * common >= percent * (size[:, None] + size - common)
        linked &= label[:, None] != label
        if t["i"][0] != t["j"][0]:
            linked &= block[:, None] != block
        edges = list(forest(linked))
        a, b = [label[x] for x, _ in edges], [label[y] for _, y in edges]
    return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _groups(active: DataFrame, classes: DataFrame) -> DataFrame:
    """``group, node``: sets of classes to be compared among themselves, so that all that share a key are.

    Groups are keys, or all classes that a chain of keys connects where that makes fewer pairs.
    """
    keys = written(active.groupBy("key").agg(F.min("node").alias("hub"), F.count("*").cast("double").alias("n")), "near-open")
    chained = written(components(active.join(keys, "key").select(F.col("hub").alias("a"), F.col("node").alias("b")))
                      .withColumnRenamed("component", "chain"), "near-chains")
    # a key's chain is its hub's, so that chains are weighed with a row a key and a row a class
    chain_of = keys.join(chained.withColumnRenamed("node", "hub"), "hub")
    by_key = chain_of.groupBy("chain").agg(F.sum(F.col("n") * F.col("n")).alias("by_key"))
    whole = written(chained.groupBy("chain").agg(F.count("*").cast("double").alias("n")).join(by_key, "chain")
                    .filter(F.col("n") * F.col("n") <= F.col("by_key")).select("chain"), "near-whole")
    one = chained.join(whole, "chain", "left_semi").select(F.lit(0).alias("kind"), F.col("chain").alias("group"), "node")
    apart = chain_of.join(whole, "chain", "left_anti").select("key")
    many = active.join(apart, "key").select(F.lit(1).alias("kind"), F.col("key").alias("group"), "node")
    return written(one.unionByName(many).join(classes.select("node", "n"), "node"), "near-groups")


def _tiled(active: DataFrame, labels: DataFrame, classes: DataFrame, sets: DataFrame, percent: int,
           most_rows: int = TILE_ROWS, most_bytes: int = TILE_BYTES) -> DataFrame:
    """``a, b``: labels joined by links between classes of one key (a spanning forest of a tile's)."""
    groups = _groups(active, classes)
    blocks = groups.groupBy("kind", "group").agg(F.greatest(
        F.ceil(F.count("*") / most_rows), F.ceil(F.sum(F.col("n") * 8) / most_bytes)).cast("int").alias("blocks"))
    placed = (groups.join(blocks, ["kind", "group"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
              .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
              .select("kind", "group", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node"))
    full = placed.join(labels, "node").join(sets, "node").drop("node")
    tile, parts = ["kind", "group", "i", "j"], int(active.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return full.repartition(parts, *tile).groupBy(*tile).applyInArrow(lambda t: _tile(t, percent), "a long, b long")


def _joined(labels: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The labels after ``links`` between them, and the changed ones with what they became."""
    moved = written(components(links).select(F.col("node").alias("label"), "component"), "near-moved")
    return written(_relabelled(labels, moved), "near-labels"), moved


def _relabelled(df: DataFrame, moved: DataFrame) -> DataFrame:
    return df.join(moved, "label", "left").withColumn("label", F.coalesce("component", "label")).drop("component")


def _labels(classes: DataFrame, rows: DataFrame, words: int, percent: int) -> DataFrame:
    """``node, label``: the component of every class that shares a key with another (its smallest node)."""
    index = classes.select("node", "signature").mapInArrow(_index, "key long, node long")
    shared = written(index.groupBy("key").agg(F.min("node").alias("low"), F.max("node").alias("high"))
                     .filter("low < high").select("key", F.col("low").alias("hub")), "near-keys")
    active = written(index.join(shared, "key"), "near-index")
    labels = written(active.select("node", F.col("node").alias("label")).distinct(), "near-labels")
    sets = written(rows.join(labels.select(F.col("node").alias(RID)), RID, "left_semi").select(F.col(RID).alias("node"), "text")
                   .mapInArrow(lambda b: _set_rows(b, words), "node long, shingles binary"), "near-sets")
    pairs = written(active.filter("node <> hub").select(F.col("hub").alias("a"), F.col("node").alias("b")).distinct(), "near-candidates")
    # so far every class is its own label
    labels, moved = _joined(labels, _tested(pairs, classes, sets, percent))
    left = written(_relabelled(active.filter("node <> hub").select("key", "node", F.col("node").alias("label")), moved), "near-index")
    open_ = left.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("key")
    left = written(left.join(open_, "key").select("key", "node"), "near-index")
    if not left.isEmpty():
        labels, _ = _joined(labels, written(_tiled(left, labels, classes, sets, percent), "near-links"))
    return labels


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, percent: int = PERCENT,
                has_rid: bool = False) -> DataFrame:
    """One row per input row: row number, ``doc_id, n_shingles, component, component_id, kept``.

    ``component`` is the component's own key (a row number of it), which tells apart components whose
    ``component_id`` is null or the same.  ``has_rid``: the rows are numbered.
    """
    rows = identified(docs, doc_id, text, has_rid)
    signed = written(rows.mapInArrow(lambda b: _sign(b, words), f"{RID} long, doc_id long, n_shingles long, set_key binary, signature binary"),
                     "near-docs")
    classes = written(signed.filter("n_shingles > 0").groupBy("set_key")
                      .agg(F.min(RID).alias("node"), F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"),
                           F.first("signature").alias("signature")), "near-classes")
    labels = _labels(classes, rows, words, percent)
    grouped = (classes.select("set_key", "node", "first").join(labels, "node", "left")
               .withColumn("component", F.coalesce("label", "node")))
    smallest = written(grouped.groupBy("component").agg(F.min("first").alias("component_id")), "near-smallest")
    by_set = written(grouped.join(smallest, "component").select("set_key", "component", "component_id"), "near-sets-of")
    linked = signed.filter("n_shingles > 0").join(by_set, "set_key").select(RID, "doc_id", "n_shingles", "component", "component_id")
    alone = signed.filter("n_shingles = 0").select(RID, "doc_id", "n_shingles", F.col(RID).alias("component"), F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one row with the smallest doc_id of each component; texts without words all stay."""
    docs = numbered(docs)
    kept = only_result(docs.sparkSession, lambda: near_groups(docs, has_rid=True).filter("kept").select("component", RID), "near-kept")
    return keep_rows(docs, kept.groupBy("component").agg(F.min(RID).alias(RID)))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all ``documents``."""
    return near_groups(table(spark, sf_dir, "documents")).drop(RID, "component")
