"""Operator 6: removal of repeated 400-byte strings by external induced sorting.

A string of ``LENGTH`` bytes that starts at two places is found by sorting
suffixes and reading the common prefixes of neighbours.  Which suffixes must
meet is settled first: every window of ``LENGTH`` bytes is anchored at its
smallest k-mer (by hash, leftmost), a function of the window alone, so equal
windows have equal anchors at equal distances.  Consecutive windows with one
anchor form a region; regions are dealt to shards by their anchor's k-mer.

* Regions whose anchor occurs once hold nothing repeated and end there, as 24
  bytes of numbers.
* Equal regions (same bytes, same place of the anchor) are counted, with
  map-side combining, and only one of them is sorted; if there are two, all
  their windows are repeated.
* Distinct regions of one k-mer are sorted.  Aligned at the anchor, the order
  of the suffixes one byte further left is *induced*: tuples (region, common
  prefix with the tuple before) are read in order and appended to the queue of
  their preceding byte; the queues read one after another are the new order.
  The new common prefix is one more than the smallest passed since the queue's
  last entry.  Repeated from the right end of the regions to their left end,
  this sorts all suffixes with their common prefixes; windows whose neighbour
  shares ``LENGTH`` bytes are repeated.

Queues, tuples and bytes live in unnamed scratch files of the task once they
pass ``memory`` bytes, and are read in blocks of ``block`` tuples, so a shard
may be far larger than memory.  A lost executor's shard is sorted again from
the shuffle; nothing is left behind.

Defined results: null text is empty; texts of fewer than ``LENGTH`` bytes keep
everything unless a string of theirs could repeat, which it cannot; repeated
rows count as separate documents (so both lose everything); null doc_ids stay
null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import RID, documents, flushed, identified, table, written
from signalmesh.session import discard, sparing_disk

LENGTH, KMER = 400, 24
MEMORY, BLOCK = 96 << 20, 1 << 18
#: Bytes whose windows are anchored together.
STRETCH = 1 << 22
END = 256  # stands for a byte outside a region: equal to none

REGIONS = pa.schema([(RID, pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("sha", pa.binary()), ("hash", pa.int64()),
                     ("key", pa.binary()), ("anchor", pa.int64()), ("lo", pa.int64()), ("hi", pa.int64())])
REGION_COLUMNS = f"{RID} long, doc_id long, n_bytes long, sha binary, hash long, key binary, anchor long, lo long, hi long"


def kmer_hashes(data: np.ndarray, k: int = KMER) -> np.ndarray:
    """A 64-bit hash of the ``k`` bytes (a multiple of 8) from every place."""
    n = len(data) - k + 1
    words = np.lib.stride_tricks.sliding_window_view(data, 8)
    h = np.zeros(n, np.uint64)
    for i in range(0, k, 8):
        w = np.ascontiguousarray(words[i: i + n]).view("<u8").reshape(n)
        h = (h ^ w) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def sliding_minimum(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of every ``width`` neighbours: running minima of blocks from both sides."""
    n = len(x) - width + 1
    full = np.full(-(-len(x) // width) * width, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    blocks = full.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1: width - 1 + n])


def regions(text: bytes, length: int = LENGTH, k: int = KMER) -> Iterator[tuple[int, int, int, int]]:
    """``(hash, anchor, lo, hi)``: windows starting in [lo, hi) have their smallest k-mer at ``anchor``."""
    place_bits = np.uint64(23)
    for at in range(0, max(0, len(text) - length + 1), STRETCH):
        data = np.frombuffer(text, np.uint8, min(STRETCH + length - 1, len(text) - at), at)
        h = kmer_hashes(data, k)
        low = sliding_minimum((h >> place_bits << place_bits) | np.arange(len(h), dtype=np.uint64), length - k + 1)
        anchor = (low & np.uint64((1 << 23) - 1)).astype(np.int64)
        starts = np.flatnonzero(np.diff(anchor, prepend=-1))
        ends = np.append(starts[1:], len(anchor))
        for a, lo, hi in zip(anchor[starts].tolist(), starts.tolist(), ends.tolist()):
            yield int(h[a].astype(np.int64)), at + a, at + lo, at + hi


def _find_regions(batches: Iterable[pa.RecordBatch], length: int, k: int) -> Iterator[pa.RecordBatch]:
    """A row per region, and one with ``hash`` null per document."""

    def rows():
        for rid, doc_id, text in documents(batches, RID, "doc_id", "text"):
            data = text.encode()
            yield rid, doc_id, len(data), hashlib.sha256(data).digest(), None, None, None, None, None
            for h, a, lo, hi in regions(data, length, k):
                key = xxhash.xxh3_128_digest(data[lo: hi + length - 1] + (a - lo).to_bytes(4, "little"))
                yield rid, None, None, None, h, key, a, lo, hi

    yield from flushed(rows(), REGIONS)


CONTENTS = pa.schema([("hash", pa.int64()), ("key", pa.binary()), ("left", pa.int64()), ("windows", pa.int64()), ("bytes", pa.binary())])


def _contents(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    def rows():
        for text, wanted in documents(batches, "text", "wanted"):
            data = text.encode()
            for w in wanted:
                yield w["hash"], w["key"], w["anchor"] - w["lo"], w["hi"] - w["lo"], data[w["lo"]: w["hi"] + length - 1]

    yield from flushed(rows(), CONTENTS, weigh=lambda r: len(r[4]))


class Scratch:
    """Arrays in memory while they fit, in unnamed files of this task beyond."""

    def __init__(self, memory: int):
        self.left = memory

    def array(self, shape, dtype) -> np.ndarray:
        size = int(np.prod(shape)) * np.dtype(dtype).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(shape, dtype)
        with tempfile.TemporaryFile() as f:  # the mapping keeps it; it has no name to be left behind
            return np.memmap(f, dtype, "w+", shape=shape)


def _range_minima(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The minimum of ``values[a+1 .. b]`` for each pair a < b."""
    out = np.empty(len(a), values.dtype)
    span = b - a
    level = np.frexp(span.astype(np.float64))[1] - 1  # floor of log2
    table_, width = values, 1
    for d in range(int(level.max()) + 1 if len(a) else 0):
        at = np.flatnonzero(level == d)
        out[at] = np.minimum(table_[a[at] + 1], table_[b[at] - width + 1])
        if len(table_) > width:
            table_ = np.minimum(table_[:-width], table_[width:])
        width *= 2
    return out


class InducedOrder:
    """Suffixes of aligned regions in order, one byte further left each step.

    ``group`` numbers the regions' anchors and is non-decreasing in the region
    number.  ``order`` and ``shared`` are the tuples: a region, and the bytes its
    suffix shares with the one before (0 for a group's first).
    """

    def __init__(self, group: np.ndarray, scratch: Scratch, block: int):
        n = len(group)
        self.group, self.block = group, block
        self.order, self.shared = scratch.array(n, np.int32), scratch.array(n, np.int32)
        self.next_order, self.next_shared = scratch.array(n, np.int32), scratch.array(n, np.int32)
        self.order[:] = np.arange(n)

    def step(self, column: np.ndarray) -> None:
        """Induce the order of the suffixes that start with ``column`` (a byte per region; END: none)."""
        n = len(self.group)
        to = 0
        open_group, queues, since = -1, {}, {}  # of the group that runs on from block to block
        for at in range(0, n, self.block):
            order, shared = np.asarray(self.order[at: at + self.block]), np.asarray(self.shared[at: at + self.block])
            group, byte = self.group[order], column[order].astype(np.int64)
            turn = np.argsort(group.astype(np.int64) * (END + 1) + byte, kind="stable")
            g, c = group[turn], byte[turn]
            same = np.zeros(len(turn), bool)
            same[1:] = (g[1:] == g[:-1]) & (c[1:] == c[:-1])
            new = np.zeros(len(turn), np.int32)
            i = np.flatnonzero(same & (c != END))
            new[i] = 1 + _range_minima(shared, turn[i - 1], turn[i])
            last = at + len(order) >= n
            runs_on = -1 if last or self.group[self.order[at + len(order)]] != group[-1] else int(group[-1])
            head = int(np.searchsorted(g, open_group, side="right")) if open_group >= 0 else 0
            if head:  # this block's part of the group that began in an earlier block
                self._append(queues, since, order, shared, turn[:head], c[:head], new[:head])
                if not (runs_on == open_group):
                    to = self._write(queues, to)
                    queues, since = {}, {}
            if runs_on >= 0 and runs_on != open_group:
                tail = int(np.searchsorted(g, runs_on))
                to = self._place(order[turn[head:tail]], new[head:tail], to)
                self._append(queues, since, order, shared, turn[tail:], c[tail:], new[tail:])
            elif runs_on < 0:
                to = self._place(order[turn[head:]], new[head:], to)
            open_group = runs_on
        self.order, self.next_order = self.next_order, self.order
        self.shared, self.next_shared = self.next_shared, self.shared

    def _append(self, queues: dict, since: dict, order, shared, turn, c, new) -> None:
        """Append to the queue of each byte; ``since`` has the smallest common prefix passed since a queue's last entry."""
        first, end = int(turn.min()), int(turn.max()) + 1
        part = shared[first:end]
        ahead = np.minimum.accumulate(part)
        back = np.minimum.accumulate(part[::-1])[::-1]
        heads = np.flatnonzero(np.diff(c, prepend=-1))
        tails = np.append(heads[1:], len(c))
        met = set()
        for h, t in zip(heads, tails):
            byte = int(c[h])
            met.add(byte)
            values = new[h:t].copy()
            if byte != END and byte in since:
                values[0] = 1 + min(since[byte], int(ahead[turn[h] - first]))
            queues.setdefault(byte, tempfile.SpooledTemporaryFile(max_size=1 << 16)).write(
                np.stack([order[turn[h:t]], values], 1).astype(np.int32).tobytes())
            after = int(turn[t - 1]) - first + 1
            since[byte] = int(back[after]) if after < len(part) else np.iinfo(np.int32).max
        for byte in since.keys() - met:
            since[byte] = min(since[byte], int(ahead[-1]))

    def _write(self, queues: dict, to: int) -> int:
        for byte in sorted(queues):
            queues[byte].seek(0)
            while part := queues[byte].read(8 * self.block):
                pairs = np.frombuffer(part, np.int32).reshape(-1, 2)
                to = self._place(pairs[:, 0], pairs[:, 1], to)
            queues[byte].close()
        return to

    def _place(self, order: np.ndarray, shared: np.ndarray, to: int) -> int:
        self.next_order[to: to + len(order)], self.next_shared[to: to + len(order)] = order, shared
        return to + len(order)

    def repeated(self, length: int) -> Iterator[np.ndarray]:
        """Regions, block by block, whose suffix shares ``length`` bytes with a neighbour."""
        n = len(self.order)
        for at in range(0, n, self.block):
            to = min(n, at + self.block)
            with_last = np.asarray(self.shared[at:to]) >= length
            with_next = np.append(with_last[1:], to < n and self.shared[to] >= length)
            yield np.asarray(self.order[at:to])[with_last | with_next]


def sort_shard(rows: Iterator[tuple[int, bytes, int, int, bytes]], length: int = LENGTH, k: int = KMER, memory: int = MEMORY,
               block: int = BLOCK) -> Iterator[tuple[int, bytes, list[int], list[int]]]:
    """``(hash, key, starts, ends)`` of the repeated windows of each region, from the region's first.

    ``rows``: ``(hash, key, left, windows, bytes)`` ordered by hash; a region's anchor lies ``left`` bytes into it.
    """
    heads, groups, spool = [], [], tempfile.SpooledTemporaryFile(max_size=memory // 4)
    last, group = None, -1
    for h, key, left, windows, data in rows:
        group += h != last
        last = h
        heads.append((h, key, left, windows, len(data)))
        groups.append(group)
        spool.write(data)
    n, far = len(heads), length - k  # a region reaches at most `far` bytes left of its anchor and `length` to its right
    if not n:
        return
    scratch = Scratch(memory)
    columns = scratch.array((far + length, n), np.uint16)  # a row per place beside the anchor, left to right
    columns[:] = END
    spool.seek(0)
    for r, (_, _, left, _, size) in enumerate(heads):
        columns[far - left: far - left + size, r] = np.frombuffer(spool.read(size), np.uint8)
    spool.close()
    left = np.array([h[2] for h in heads])
    windows = np.array([h[3] for h in heads])
    marks = scratch.array((far + 1, n), bool)
    induced = InducedOrder(np.array(groups, np.int32), scratch, block)
    for place in range(far + length - 1, -1, -1):
        induced.step(np.asarray(columns[place]))
        if place <= far:
            for at in induced.repeated(length):
                marks[place, at] = True
    for r, (h, key, *_) in enumerate(heads):
        own = np.asarray(marks[far - left[r]: far - left[r] + windows[r], r]).astype(np.int8)
        edges = np.diff(own, prepend=0, append=0)
        yield h, key, np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist()


FOUND = pa.schema([("hash", pa.int64()), ("key", pa.binary()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))])
KEPT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept", pa.binary())])


def _sorted_shards(batches: Iterable[pa.RecordBatch], length: int, k: int, memory: int, block: int) -> Iterator[pa.RecordBatch]:
    rows = documents(batches, "hash", "key", "left", "windows", "bytes")
    yield from flushed((r for r in sort_shard(rows, length, k, memory, block) if r[2]), FOUND)


def _removed(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes of repeated windows."""

    def rows():
        for doc_id, text, spans in documents(batches, "doc_id", "text", "spans"):
            data, kept, at, removed, runs = text.encode(), [], 0, 0, 0
            for span in sorted(spans, key=lambda s: s["s"]):
                s, e = span["s"], span["e"] - 1 + length
                if s > at or not runs:
                    kept.append(data[at:s])
                    runs += 1
                    at = s
                if e > at:
                    removed += e - at
                    at = e
            kept.append(data[at:])
            yield doc_id, len(data), removed, runs, b"".join(kept)

    yield from flushed(rows(), KEPT, weigh=lambda r: len(r[4]))


def _repeated_spans(rows: DataFrame, parts: DataFrame, length: int, k: int, memory: int, block: int) -> DataFrame:
    """The spans of repeated windows of each row that has some; ``parts``: the regions of all ``rows``.

    Every step is written and what it alone read is deleted, so the disk holds one step's tables and shuffles at a time.
    """
    keys = written(parts.groupBy("hash", "key").agg(F.count("*").alias("n"), F.min(F.struct(RID, "anchor", "lo", "hi")).alias("one")), "suffix-keys")
    by_hash = keys.groupBy("hash").agg(F.count("*").alias("kinds")).filter("kinds > 1").select("hash")
    sort = written(keys.join(by_hash, "hash").select("hash", "key", "n", "one.*"), "suffix-sort")
    every = written(keys.filter("n > 1").select("hash", "key", F.array(F.lit(0).cast("long")).alias("starts"),
                                                F.array(F.col("one.hi") - F.col("one.lo")).alias("ends")), "suffix-every")
    discard(keys)
    wanted = sort.groupBy(RID).agg(F.collect_list(F.struct("hash", "key", "anchor", "lo", "hi")).alias("wanted"))
    contents = (rows.select(RID, "text").join(wanted, RID).select("text", "wanted")
                .mapInArrow(lambda b: _contents(b, length), "hash long, key binary, left long, windows long, bytes binary"))
    shards = contents.repartition("hash").sortWithinPartitions("hash", "key")
    some = written(shards.mapInArrow(lambda b: _sorted_shards(b, length, k, memory, block),
                                     "hash long, key binary, starts array<long>, ends array<long>"), "suffix-some")
    alone = sort.filter("n = 1").select("hash", "key")
    repeated = every.unionByName(some.join(alone, ["hash", "key"], "left_semi"))
    spans = (parts.join(repeated, ["hash", "key"])
             .select(RID, F.explode(F.transform(F.arrays_zip("starts", "ends"), lambda x: F.struct(
                 (F.col("lo") + x["starts"]).alias("s"), (F.col("lo") + x["ends"]).alias("e")))).alias("span"))
             .groupBy(RID).agg(F.collect_list("span").alias("spans")))
    spans = written(spans, "suffix-spans")
    for read in (sort, every, some):
        discard(read)
    return spans


def drop_repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, k: int = KMER,
                  memory: int = MEMORY, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Documents that lose bytes (``doc_id, n_bytes, n_removed, n_spans, kept``: the remaining bytes) and those that do
    not (``doc_id, n_bytes, sha``: digest of the text)."""
    with sparing_disk(docs.sparkSession):
        rows = identified(docs, doc_id, text, False)
        found = written(rows.mapInArrow(lambda b: _find_regions(b, length, k), REGION_COLUMNS), "suffix-regions")
        spans = _repeated_spans(rows, found.filter("hash is not null").select(RID, "hash", "key", "anchor", "lo", "hi"), length, k, memory, block)
    lose = rows.join(spans, RID).select("doc_id", "text", "spans").mapInArrow(
        lambda b: _removed(b, length), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    keep = found.filter("hash is null").select(RID, "doc_id", "n_bytes", "sha").join(spans.select(RID), RID, "left_anti").drop(RID)
    return lose, keep


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all ``documents`` without 400-byte strings that occur twice."""
    lose, keep = drop_repeated(table(spark, sf_dir, "documents"))
    none = F.lit(0).cast("long")
    return lose.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")).unionByName(
        keep.select("doc_id", "n_bytes", none.alias("n_removed"), none.alias("n_spans"), F.lower(F.hex("sha")).alias("kept_sha256")))
