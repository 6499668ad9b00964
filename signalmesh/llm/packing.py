"""Operator 1: harmonic packing of tokenised documents into fixed-capacity sequences.

A piece of ``n`` tokens belongs to class ``j = capacity // n`` (lengths in
``(capacity/(j+1), capacity/j]``), and every bin of class ``j`` takes exactly
``j`` pieces.  Plain harmonic packing pads a bin by up to ``capacity/(j+1)``;
as documents may be cut, a remainder that would leave more than ``slack`` of a
bin empty is cut at the top of the next class (``capacity // (j+1)``, which
fills bins of that class but for less than one token a piece) and its rest is
classed again.  So a document gets few cuts and bins little padding.

Workers fill their classes' bins independently: one narrow pass over the scan
tokenises, cuts and packs, without any shuffle, and a worker holds at most one
open bin a class.  What its open bins hold at the end is cut into powers of
two and laid out largest first; the ends of those sequences fall on powers of
two, which need no padding.  A lost executor's partition is simply run again:
sequence ids come from the partition's number, and the scan's order is fixed.

Defined results: null or empty text is the end id alone (one piece of length
1); a null ``doc_id`` stays null; repeated rows are packed once each; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import array
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import documents, flushed, table, texts

CAPACITY, END_ID, SLACK = 2048, 1, 0.01
TOKENIZER = "word_bpe_49k.json"
#: Words a generation of a worker's cache holds (memory bound only: a forgotten word is encoded again).
CACHED = 400_000
#: Characters of a text split into words at once.
CHUNK = 1 << 20
#: Below this code point Python's and the tokenizer's lower case and classes agree.
PLAIN = "\u0250"
STEM = re.compile(r"([^\W\d_]+)([^\w\s]*)")

SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
                    ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _packed(ids: Iterable[int]) -> bytes:
    return array.array("I", ids).tobytes()


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printing ones for themselves, the others moved up."""
    kept = {*range(33, 127), *range(161, 173), *range(174, 256)}
    moved = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in kept)}
    return "".join(chr(b if b in kept else moved[b]) for b in range(256))


class WordIds(dict):
    """Token ids of words as little-endian 32-bit bytes: a cache of two generations.

    The tokenizer drops white space and never joins across it, so a text's ids
    are its words' ids in order.  A plain word (letters, then marks) goes
    straight to the merge model, any other through the whole tokenizer.
    """

    def __init__(self, path: str, cached: int = CACHED):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.letters, self.cached, self.old = self.tokenizer.model, _byte_letters(), cached, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            ids = self._encode(word)
        self[word] = ids
        return ids

    def _merge(self, run: str) -> list[int]:
        # printing letters stand for themselves in the vocabulary, all other bytes for another letter
        letters = run if run.isascii() and run.isprintable() else run.encode().decode("latin-1").translate(self.letters)
        return [t.id for t in self.model.tokenize(letters)]

    def _encode(self, word: str) -> bytes:
        m = word and max(word) < PLAIN and STEM.fullmatch(word.lower())
        if m and m[1].isalpha():
            return _packed(self._merge(m[1]) + (self._merge(m[2]) if m[2] else []))
        return _packed(self.tokenizer.encode(word, add_special_tokens=False).ids)

    def text(self, text: str) -> bytes:
        out, at = [], 0
        while at < len(text):
            if len(self) > self.cached:
                self.old = dict(self)
                self.clear()
            to = len(text) if len(text) - at <= CHUNK else text.find(" ", at + CHUNK)
            to = len(text) if to < 0 else to
            out.append(b"".join(map(self.__getitem__, text[at:to].replace("\n", " ").split(" "))))
            at = to
        return b"".join(out)


def cuts(n: int, capacity: int = CAPACITY, slack: float = SLACK) -> Iterator[int]:
    """Lengths of the pieces of a document of ``n`` tokens, first to last."""
    while n >= capacity:
        yield capacity
        n -= capacity
    while n:
        j = capacity // n
        piece = n if j * n >= capacity * (1 - slack) else capacity // (j + 1)
        yield piece
        n -= piece


class Bins:
    """The open bins of one worker. ``add`` and ``close`` yield finished rows."""

    def __init__(self, first_id: int, capacity: int):
        self.next_id, self.capacity, self.open = first_id, capacity, {}

    def _sequence(self, pieces: list[tuple]) -> Iterator[tuple]:
        offset = 0
        for doc_id, start, ids, doc_tokens in pieces:
            yield doc_id, start, len(ids) // 4, ids, doc_tokens, self.next_id, offset
            offset += len(ids) // 4
        self.next_id += 1

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> Iterator[tuple]:
        j = self.capacity // (len(ids) // 4)
        bin_ = self.open.setdefault(j, [])
        bin_.append((doc_id, start, ids, doc_tokens))
        if len(bin_) == j:
            yield from self._sequence(self.open.pop(j))

    def close(self) -> Iterator[tuple]:
        by_size: dict[int, list[tuple]] = {}
        for pieces in self.open.values():
            for doc_id, start, ids, doc_tokens in pieces:
                n, at = len(ids) // 4, 0
                while at < n:
                    size = 1 << ((n - at).bit_length() - 1)
                    by_size.setdefault(size, []).append((doc_id, start + at, ids[4 * at: 4 * (at + size)], doc_tokens))
                    at += size
        left = sum(size * len(pieces) for size, pieces in by_size.items())
        pieces, room = [], 0
        for size in sorted(by_size, reverse=True):
            for piece in by_size[size]:
                if not room:  # the longest power of two that what is left fills
                    room = min(1 << (left.bit_length() - 1), 1 << (self.capacity.bit_length() - 1))
                    left -= room
                pieces.append(piece)
                room -= size
                if not room:
                    yield from self._sequence(pieces)
                    pieces = []
        self.open = {}


@lru_cache(maxsize=2)
def _worker_encoder(path: str) -> WordIds:
    """A Python worker serves many tasks, which share its cache."""
    return WordIds(path)


def _pack(batches: Iterable[pa.RecordBatch], path: str | None, capacity: int, end_id: int, slack: float) -> Iterator[pa.RecordBatch]:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(TOKENIZER)
    encode = _worker_encoder(path).text
    end = end_id.to_bytes(4, "little")
    bins = Bins(TaskContext.get().partitionId() << 40, capacity)

    def rows():
        for doc_id, text in documents(batches, "doc_id", "text"):
            ids, start = encode(text) + end, 0
            n = len(ids) // 4
            for length in cuts(n, capacity, slack):
                yield from bins.add(doc_id, start, ids[4 * start: 4 * (start + length)], n)
                start += length
        yield from bins.close()

    yield from flushed(rows(), SCHEMA, weigh=lambda r: len(r[3]))


def harmonic_pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", tokenizer: str | None = None,
                  capacity: int = CAPACITY, end_id: int = END_ID, slack: float = SLACK) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids`` (little-endian unsigned
    32-bit token ids), ``doc_tokens, sequence_id, offset``.

    ``tokenizer`` is a file's path on the executors (default: the public
    ``word_bpe_49k.json``); ``slack`` is the share of a bin that may stay empty
    rather than cut a document once more.
    """
    return texts(docs, doc_id, text).mapInArrow(
        lambda batches: _pack(batches, tokenizer, capacity, end_id, slack),
        "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def op1_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` in sequences of at most 2048 tokens."""
    p = harmonic_pack(table(spark, sf_dir, "documents"))
    return p.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
