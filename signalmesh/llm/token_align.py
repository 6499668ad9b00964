"""Operator 11: alignment of two tokenizers' tokens over whole texts, by diagonal run skipping.

Both token streams cover the same bytes (a space and the text), so a token is
told by the byte offset of its end, and the places where tokens of both streams
end cut the streams into groups.  Over most of a text the groups are one token
to one token: there ``a_ends[i + t] == b_ends[j + t]`` at an unchanged index
shift ``j - i``.  Such a run is found by exponential probing: blocks of doubling
width are compared at the current shift until one differs, and the lowest bit in
which the two blocks differ tells the first difference in it.  The irregular group that stands there is resolved
token by token, and the shift is updated to where it ends.  The links of a
text's irregular groups (the pairs whose byte ranges overlap) are named together:
the ends of both sides cut a group's bytes into parts, and each is one link.

Link counts of the whole corpus come back to each document without any table
held by all tasks: a worker cuts its documents into chunks of about two million
links and writes, for each id pair of a chunk, the chunk's documents that hold it
(two bytes a link).  Pairs are counted from these rows; the counts meet them again by pair
and then by chunk.  A pair that is everywhere so has one row a chunk, whatever
its number of links.  Token streams are encoded once: documents and pairs
leave in one written table.

Long texts are tokenised in parts cut before a single space between two visible ASCII
characters, where neither vocabulary joins anything.  The byte-level vocabulary
is read by two libraries: the faster one where both know the part's characters
alike and no run is long, the other elsewhere; the ids are the same.

Defined results: null and empty texts, and texts whose joined token bytes differ
from a space and the text, have no tokens: zeros and an empty string; repeated
rows count and are returned each; a null ``doc_id`` stays null; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import documents, table, texts, written

BYTE_BPE, BYTE_RANKS, PIECES = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"
#: Documents of a chunk (an index is two bytes), and the links after which it is closed.
CHUNK_DOCS, CHUNK_LINKS = 4096, 1 << 21
#: Bits of a document's index and of an id of the piece vocabulary in a number that holds a link.
INDEX_BITS, ID_BITS = 12, 22
#: What follows an id in the text of a group: another id of its side, the other side, the next group.
SEPARATORS = ",|;"
#: Characters of a text tokenised at once.
PART = 1 << 17
CUT = re.compile(r"(?<=[!-~]) (?=[!-~])")
#: Up to the code point before this one both readers of the byte-level vocabulary know the same letters and digits.
WIDE = re.compile("[^\x00-\u024f]")
#: Characters without a space, or spaces in a row, beyond which the faster reader is slow.
LONG_RUN, LONG_GAP = 2000, " " * 400

OUT = pa.schema([("chunk", pa.int64()), ("idx", pa.int32()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()),
                 ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pair", pa.int64()), ("links", pa.binary())])
OUT_SQL = "chunk long, idx int, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pair long, links binary"
SCORED = pa.schema([("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()),
                    ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])
SCORED_SQL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"


def runs(a_ends: np.ndarray, b_ends: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
    """Stretches of two rising end arrays that end alike: ``(i, i_to, j, j_to)``.

    Either a run of one-to-one groups, as many of ``a`` as of ``b`` (also a
    single one), or one irregular group, whose sides differ or hold several.
    A run comes as ``(i, -i_to, j, j_to)``, so that both can be told apart.
    """
    i = j = 0
    n = len(a_ends)
    # blocks are compared as bytes, single ends as numbers
    a_raw, b_raw = (e.astype(np.int64).tobytes() for e in (a_ends, b_ends))
    a, b = memoryview(a_raw).cast("q"), memoryview(b_raw).cast("q")
    while i < n:
        if a[i] == b[j]:
            at, shift, width = 8 * i, 8 * (j - i), 64
            while (x := a_raw[at: at + width]) == (y := b_raw[at + shift: at + shift + width]) and x:
                at += width
                width *= 2
            # the block at ``at`` differs somewhere (or is past the end): its lowest unlike bit tells where
            unlike = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            at += (unlike & -unlike).bit_length() // 64 * 8
            i_to = min(at // 8, n)
            yield i, -i_to, j, j + i_to - i
            i, j = i_to, j + i_to - i
            if i >= n:
                return
        x, y = i, j
        a_end, b_end = a[x], b[y]
        while a_end != b_end:
            if a_end < b_end:
                x += 1
                a_end = a[x]
            else:
                y += 1
                b_end = b[y]
        yield i, x + 1, j, y + 1
        i, j = x + 1, y + 1


def _members(n: int, first: np.ndarray, to: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``n`` tokens lie in an irregular group ``first[k]:to[k]``, and which are the last of any group."""
    step = np.zeros(n + 1, np.int8)
    step[first] += 1
    step[to] -= 1
    inside = np.cumsum(step[:-1], dtype=np.int8).astype(bool)
    last = ~inside
    last[to - 1] = True
    return inside, last


def align(a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, names: np.ndarray) -> tuple[int, np.ndarray, np.ndarray, str]:
    """Number of groups, the links' ids of either side, and the groups as text; ``names``: ids as text, followed by each of ``SEPARATORS``."""
    stretches = np.fromiter(chain.from_iterable(runs(a_ends, b_ends)), np.int64).reshape(-1, 4)
    i, i_to, j, j_to = stretches[stretches[:, 1] > 0].T
    (in_a, last_a), (in_b, last_b) = _members(len(a), i, i_to), _members(len(b), j, j_to)
    # an irregular group's links: its byte range is cut at every end of either side, and each part lies in one token of each
    at_a, at_b = np.flatnonzero(in_a), np.flatnonzero(in_b)
    to_a, to_b = a_ends[at_a], b_ends[at_b]
    cuts = np.sort(np.concatenate([to_a, to_b[~last_b[at_b]]]), kind="stable")
    link_a = np.concatenate([a[~in_a], a[at_a[np.searchsorted(to_a, cuts)]]])
    link_b = np.concatenate([b[~in_b], b[at_b[np.searchsorted(to_b, cuts)]]])
    # the text: a group's tokens of one side, then those of the other
    upto_a, upto_b = np.flatnonzero(last_a) + 1, np.flatnonzero(last_b) + 1
    said = np.empty(len(a) + len(b), object)
    said[np.arange(len(a)) + np.concatenate([[0], upto_b])[np.cumsum(last_a) - last_a]] = names[last_a.astype(np.int8), a]
    said[np.arange(len(b)) + upto_a[np.cumsum(last_b) - last_b]] = names[last_b.astype(np.int8) * 2, b]
    return len(upto_a), link_a, link_b, "".join(said.tolist())[:-1]


def _byte_letters() -> dict[str, int]:
    """Byte of each letter of a byte-level vocabulary: printing ones stand for themselves, the others are moved up."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = sorted(set(range(256)) - set(kept))
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(moved)}


class ByteTokens:
    """Token ids and token bytes of the byte-level vocabulary."""

    def __init__(self, path: str, ranks: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.slow = Tokenizer.from_file(path)
        self.slow.encode_special_tokens = True
        with open(ranks, "rb") as lines:
            table_ = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table_, special_tokens={})
        letters = _byte_letters()
        self.bytes: dict[int, bytes] = {}
        for token, at in self.slow.get_vocab(with_added_tokens=False).items():
            self.bytes[at] = bytes(letters[c] for c in token) if all(c in letters for c in token) else token.encode()

    def ids(self, part: str) -> np.ndarray:
        if (part.isascii() or not WIDE.search(part)) and LONG_GAP not in part and max(map(len, part.split(" "))) < LONG_RUN:
            return self.fast.encode_to_numpy(part)
        return np.array(self.slow.encode(part, add_special_tokens=False).ids, np.uint32)


class PieceTokens:
    """Token ids and token bytes of the piece vocabulary, which adds a space itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {}
        for at in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(at)
            self.bytes[at] = bytes([int(piece[3:5], 16)]) if self.model.is_byte(at) else piece.replace("▁", " ").encode()

    def ids(self, part: str) -> np.ndarray:
        return np.array(self.model.encode(part), np.uint32)


class Sides:
    """Both vocabularies: tokens of whole texts."""

    def __init__(self, byte_tokens: ByteTokens, piece_tokens: PieceTokens, part: int = PART):
        self.byte_tokens, self.piece_tokens, self.part = byte_tokens, piece_tokens, part
        tables = byte_tokens.bytes, piece_tokens.bytes
        self.bytes, self.sizes = [], []
        for t in tables:
            held = [t.get(i, b"") for i in range(max(t) + 1)]
            self.bytes.append(np.array([*held, None], object)[:-1])
            self.sizes.append(np.array(list(map(len, held)), np.int64))
        self.names = np.array([[f"{i}{after}" for i in range(max(map(len, self.bytes)))] for after in SEPARATORS], object)

    def parts(self, text: str) -> Iterator[str]:
        """The text without the spaces it is cut at."""
        at = 0
        while len(text) - at > self.part and (cut := CUT.search(text, at + self.part)):
            yield text[at: cut.start()]
            at = cut.end()
        yield text[at:]

    def tokens(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both sides and their ends; nothing where either side's bytes are not a space and the text."""
        none = np.zeros(0, np.uint32)
        held = [(self.byte_tokens.ids(" " + part), self.piece_tokens.ids(part)) for part in self.parts(text)] if text else []
        ids = [np.concatenate([none, *x]) for x in zip(*held)] if len(held) != 1 else list(held[0])
        whole = b" " + text.encode()
        if not text or any(b"".join(t[x].tolist()) != whole for t, x in zip(self.bytes, ids)):
            ids = [none, none]
        return *ids, *[np.cumsum(sizes[x]) for sizes, x in zip(self.sizes, ids)]


@lru_cache(maxsize=1)
def _sides(byte_bpe: str, byte_ranks: str, pieces: str) -> Sides:
    """Read once for all tasks of a Python worker."""
    return Sides(ByteTokens(byte_bpe, byte_ranks), PieceTokens(pieces))


class Chunk:
    """Documents and links of one chunk, written out together."""

    def __init__(self, number: int):
        self.number, self.docs, self.pairs, self.n_links = number, [], [], 0

    def add(self, doc_id, text: str, sides: Sides) -> None:
        a, b, a_ends, b_ends = sides.tokens(text)
        n_groups, link_a, link_b, said = align(a, b, a_ends, b_ends, sides.names)
        digest = hashlib.sha256(said.encode()).hexdigest() if len(a) else ""
        self.docs.append((doc_id, len(a), len(b), n_groups, len(link_a), digest))
        # a link as one number: both ids, and the document's index
        self.pairs.append((link_a.astype(np.int64) << ID_BITS | link_b.astype(np.int64)) << INDEX_BITS | np.int64(len(self.docs) - 1))
        self.n_links += len(link_a)

    def full(self) -> bool:
        return len(self.docs) >= CHUNK_DOCS or self.n_links >= CHUNK_LINKS

    def batches(self) -> Iterator[pa.RecordBatch]:
        n = len(self.docs)
        number = pa.array(np.full(n, self.number, np.int64))
        columns = [pa.array(c, type=f.type) for c, f in zip(zip(*self.docs), list(OUT)[2:8])]
        yield pa.RecordBatch.from_arrays([number, pa.array(np.arange(n, dtype=np.int32)), *columns, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())],
                                         schema=OUT)
        if not self.n_links:
            return
        pairs = np.sort(np.concatenate(self.pairs))
        docs, pairs = (pairs & (1 << INDEX_BITS) - 1).astype("<u2"), pairs >> INDEX_BITS
        first = np.flatnonzero(np.r_[True, pairs[1:] != pairs[:-1]])
        bounds = (np.r_[first, len(pairs)] * docs.itemsize).astype(np.int32)
        pairs = pairs[first]
        links = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(bounds.tobytes()), pa.py_buffer(docs.tobytes())])
        n = len(first)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, self.number, np.int64)), *(pa.nulls(n, f.type) for f in list(OUT)[1:8]),
                                          pa.array(pairs >> ID_BITS << 32 | pairs & (1 << ID_BITS) - 1), links], schema=OUT)


def _aligned(batches: Iterable[pa.RecordBatch], paths: tuple[str | None, str | None, str | None]) -> Iterator[pa.RecordBatch]:
    import public_tokenizers

    names = (BYTE_BPE, BYTE_RANKS, PIECES)
    sides = _sides(*[p or public_tokenizers.path(n) for p, n in zip(paths, names)])
    number = TaskContext.get().partitionId() << 40
    chunk = Chunk(number)
    for doc_id, text in documents(batches, "doc_id", "text"):
        chunk.add(doc_id, text, sides)
        if chunk.full():
            yield from chunk.batches()
            chunk = Chunk(number := number + 1)
    if chunk.docs:
        yield from chunk.batches()


def _summed(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """The documents of one chunk with the sums over their links."""
    n = len(docs)
    idx = docs["idx"].to_numpy()
    best, total = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if len(pairs):
        held = pairs["links"].to_pylist()
        at = np.frombuffer(b"".join(held), "<u2")
        sizes = np.fromiter(map(len, held), np.int64, len(held)) // at.itemsize
        np.add.at(total, at, np.repeat(pairs["n"].to_numpy(), sizes))
        np.add.at(best, at, np.repeat(pairs["n"].to_numpy() == pairs["top"].to_numpy(), sizes).astype(np.int64))
    columns = {"n_best": pa.array(best[idx]), "count_sum": pa.array(total[idx])}
    return pa.Table.from_arrays([columns[f.name] if f.name in columns else docs[f.name] for f in SCORED], schema=SCORED)


def align_tokenizers(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", byte_bpe: str | None = None,
                     byte_ranks: str | None = None, pieces: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Documents, and the corpus-wide counts of linked id pairs.

    Documents: ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``.
    Pairs: ``a_id, b_id, n`` and ``top`` (the highest count of the ``b_id``).
    The vocabularies are files on the executors (default: the public ones).
    """
    paths = (byte_bpe, byte_ranks, pieces)
    both = written(texts(docs, doc_id, text).mapInArrow(lambda b: _aligned(b, paths), OUT_SQL), "align-chunks")
    held = both.filter("pair is not null").select("chunk", "pair", "links")
    counts = written(held.groupBy("pair").agg(F.shiftright(F.sum(F.octet_length("links")), 1).cast("long").alias("n")), "align-counts")
    b_id = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    counts = counts.withColumn("b_id", b_id)
    # a B id has at most one pair for each entry of the other vocabulary
    scored = counts.join(counts.groupBy("b_id").agg(F.max("n").alias("top")), "b_id")
    again = held.join(scored.select("pair", "n", "top"), "pair").groupBy("chunk")
    # a new column of the same numbers: both sides of a cogroup must be told apart
    rows = both.filter("pair is null").select(F.col("chunk").alias("chunk"), "idx", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    out = rows.groupBy("chunk").cogroup(again).applyInArrow(_summed, SCORED_SQL)
    return out, scored.select(F.shiftright("pair", 32).alias("a_id"), "b_id", "n", "top")


def op11_token_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of the byte-level and the piece vocabulary over all ``documents``."""
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]
