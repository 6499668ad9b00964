"""Words and pairs of words met in texts by tables of whole numbers, a batch of texts at a time.

The keywords are single words and pairs ``w1 w2`` (a word is a run of ``[A-Za-z0-9_]``).  Their
distinct words have numbers; a pair is two of them in one 64-bit key, exact as it is.  A
text's words are found by arrays of its bytes, and each distinct word of a batch is looked up once:
itself, its ends that begin a pair and its beginnings that end one (a pair is a
plain substring, so its first word may be the end of a longer one and its last word
the beginning of one).  Two words with one space between then meet the pairs of all their numbers.

Hashes only choose where to look: what is found there is compared byte by byte.  The
cost of a text is the same for any number of keywords.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

WORD_BYTE = np.zeros(256, bool)
WORD_BYTE[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_"]] = True
#: What is left of eight bytes when a string ends among them.
LEFT = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
MIX, SPREAD, BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(32)
#: Pairs of numbers looked up, and blocks of themes gathered, at a time.
AT_ONCE = 1 << 20


def padded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes, and the eight bytes from each of them on as one number."""
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    return data, np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def _bytes(buffer: pa.Buffer | None) -> np.ndarray:
    return np.frombuffer(buffer, np.uint8) if buffer and buffer.size else np.zeros(0, np.uint8)


def hashed(eights: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hashes of the strings of ``size`` bytes from ``at`` on."""
    h = (eights[at] & LEFT[np.minimum(size, 8)] ^ size.astype(np.uint64)) * MIX
    h ^= h >> BITS
    more, done = np.flatnonzero(size > 8), 8
    while len(more):
        part = (h[more] ^ eights[at[more] + done] & LEFT[np.minimum(size[more] - done, 8)]) * MIX
        h[more] = part ^ part >> BITS
        done += 8
        more = more[size[more] > done]
    return h * SPREAD


def same(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the ``size`` bytes from ``at`` and ``bt`` on are equal."""
    equal = ((a[at] ^ b[bt]) & LEFT[np.minimum(size, 8)]) == 0
    more, done = np.flatnonzero(equal & (size > 8)), 8
    while len(more):
        one = ((a[at[more] + done] ^ b[bt[more] + done]) & LEFT[np.minimum(size[more] - done, 8)]) == 0
        equal[more[~one]] = False
        more = more[one]
        done += 8
        more = more[size[more] > done]
    return equal


@dataclass
class Places:
    """Where things of a hash lie: those of one place stand together, at ``first[place]`` and after."""

    shift: np.uint64
    first: np.ndarray

    @classmethod
    def of(cls, hashes: np.ndarray) -> tuple[Places, np.ndarray]:
        """The places, and the order that the things are to be put in."""
        bits = max(1, int(2 * len(hashes)).bit_length())
        place = (hashes >> np.uint64(64 - bits)).astype(np.int64)
        first = np.zeros((1 << bits) + 1, np.int32)
        np.cumsum(np.bincount(place, minlength=1 << bits), out=first[1:])
        return cls(np.uint64(64 - bits), first), np.argsort(place, kind="stable")

    def found(self, hashes: np.ndarray, is_it) -> np.ndarray:
        """For each hash the number of the thing of which ``is_it(which hashes, numbers)`` holds, or -1."""
        place = (hashes >> self.shift).astype(np.int64)
        at, end = self.first[place], self.first[place + 1]
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            yes = is_it(open_, at[open_])
            out[open_[yes]] = at[open_[yes]]
            open_ = open_[~yes]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return out


@dataclass
class Tables:
    """Keywords of some themes: words by number, pairs by their words' numbers, and the themes of each.

    Keyword ``k`` is word ``k`` if ``k`` is below the count of words, and else a pair; its
    themes are the bits of ``mask[of[k]:of[k + 1]]``, 64 to a ``block``.
    """

    themes: pa.Array
    places: Places
    hashes: np.ndarray
    data: np.ndarray
    at: np.ndarray
    size: np.ndarray
    longest: int
    #: Which words begin a pair, and the sizes that these have; which end one.
    begins: tuple[np.ndarray, np.ndarray]
    ends: tuple[np.ndarray, np.ndarray]
    pair_places: Places
    pairs: np.ndarray
    of: np.ndarray
    block: np.ndarray
    mask: np.ndarray

    def words(self, eights: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The numbers of the strings of ``size`` bytes from ``at`` on, or -1."""
        own = np.ndarray(len(self.data) - 7, "<u8", self.data, strides=(1,))
        h = hashed(eights, at, size)

        def is_it(which, n):
            yes = (self.hashes[n] == h[which]) & (self.size[n] == size[which])
            some = np.flatnonzero(yes)
            yes[some] = same(eights, at[which[some]], own, self.at[n[some]], size[which[some]])
            return yes

        return self.places.found(h, is_it)

    def found_pairs(self, key: np.ndarray) -> np.ndarray:
        """The keywords that are these pairs, or -1."""
        k = self.pair_places.found(key * MIX, lambda which, n: self.pairs[n] == key[which])
        return np.where(k < 0, k, k + len(self.size))


def pair_key(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return first.astype(np.uint64) << BITS | last.astype(np.uint64)


def tables(rows: pa.Table) -> Tables:
    """Of ``theme, first, last``: the keyword is ``first`` alone where ``last`` is null."""
    # themes, a null one among them, and words as whole numbers; the driver lets go of each column as soon as it can
    themes = rows["theme"].combine_chunks().dictionary_encode(null_encoding="encode")
    n_blocks = len(themes.dictionary) // 64 + 1
    theme = themes.indices.to_numpy().astype(np.int32)
    themes = themes.dictionary
    is_pair = pc.is_valid(rows["last"]).to_numpy()
    text = pa.large_string()
    codes = pa.chunked_array([*rows["first"].cast(text).chunks, *rows["last"].drop_null().cast(text).chunks], text)
    del rows
    codes = codes.dictionary_encode().combine_chunks() if len(codes) else pa.array([], text).dictionary_encode()
    word, code = codes.dictionary, codes.indices.to_numpy()
    _, offsets, data = word.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(word) + 1, word.offset * 8) if len(word) else np.zeros(1, np.int64)
    data, eights = padded(_bytes(data)[:offsets[-1]])
    at, size = offsets[:-1], np.diff(offsets)
    hashes = hashed(eights, at, size)
    places, order = Places.of(hashes)
    hashes, at, size = hashes[order], at[order], size[order]
    code = inverse(order)[code]
    first, last = code[:len(is_pair)], code[len(is_pair):]
    begins, ends = np.zeros(len(order), bool), np.zeros(len(order), bool)
    begins[first[is_pair]] = ends[last] = True
    # pairs in the order of their places
    pairs, which = np.unique(pair_key(first[is_pair], last), return_inverse=True)
    pair_places, order = Places.of(pairs * MIX)
    keyword = first.astype(np.int64)
    keyword[is_pair] = len(size) + inverse(order)[which]
    pairs = pairs[order]
    del codes, word, code, first, last, which, order
    keyword *= n_blocks
    keyword += theme // 64
    theme %= 64
    cell, mask = merged(keyword, np.uint64(1) << theme.astype(np.uint64))
    of = np.searchsorted(cell, np.arange(len(size) + len(pairs) + 1) * n_blocks).astype(np.int32)
    cell %= n_blocks
    return Tables(themes, places, hashes, data, at, size, int(size.max(initial=0)), (begins, np.unique(size[begins])), (ends, np.unique(size[ends])),
                  pair_places, pairs, of, cell.astype(np.int32), mask)


def inverse(order: np.ndarray) -> np.ndarray:
    """The place of each number in ``order``."""
    out = np.empty(len(order), np.int32)
    out[order] = np.arange(len(order), dtype=np.int32)
    return out


def merged(cell: np.ndarray, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each cell once, sorted, with the bits of all its masks."""
    if not len(cell):
        return cell, mask
    order = np.argsort(cell, kind="stable")
    cell = cell[order]
    first = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]]))
    return cell[first], np.bitwise_or.reduceat(mask[order], first)


def ranges(start: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of the ranges, and which range each is of."""
    which = np.repeat(np.arange(len(count)), count)
    return np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count) + start[which], which


def portions(count: np.ndarray) -> list[np.ndarray]:
    """The numbers of ``count`` in runs whose counts come to about ``AT_ONCE``."""
    return np.split(np.arange(len(count)), np.flatnonzero(np.diff(np.cumsum(count) // AT_ONCE)) + 1)


@dataclass
class Words:
    """The words of texts: where they lie, whose they are, and which distinct word each is."""

    eights: np.ndarray
    at: np.ndarray
    size: np.ndarray
    text: np.ndarray
    which: np.ndarray
    one: np.ndarray
    #: Numbers of those words that the next one follows after a space.
    followed: np.ndarray


def cut(data: np.ndarray, offsets: np.ndarray, longest: int) -> Words:
    """The words of the texts that lie between ``offsets``; those longer than ``longest`` are not told apart from equal ones, each counts as distinct."""
    n = len(data)
    data, eights = padded(data)
    is_word = WORD_BYTE[data[:n]]
    opens, closes = is_word.copy(), is_word.copy()
    opens[1:] &= ~is_word[:-1]
    closes[:-1] &= ~is_word[1:]
    full = offsets[:-1][np.diff(offsets) > 0]
    opens[full] = is_word[full]
    full = offsets[1:][np.diff(offsets) > 0] - 1
    closes[full] = is_word[full]
    at = np.flatnonzero(opens)
    size = np.flatnonzero(closes) + 1 - at
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(at, offsets)))
    end = (at + size)[:-1]
    followed = np.flatnonzero((at[1:] == end + 1) & (data[end] == 32) & (text[1:] == text[:-1]))
    which = np.empty(len(at), np.int64)
    short = np.flatnonzero(size <= longest)
    _, one, which[short] = np.unique(hashed(eights, at[short], size[short]), return_index=True, return_inverse=True)
    one = short[one]
    as_ = one[which[short]]
    alone = np.zeros(len(at), bool)
    alone[size > longest] = True
    alone[short] = size[short] != size[as_]
    twin = short[~alone[short]]
    alone[twin] = ~same(eights, at[twin], eights, at[one[which[twin]]], size[twin])
    alone = np.flatnonzero(alone)
    which[alone] = len(one) + np.arange(len(alone))
    return Words(eights, at, size, text, which, np.concatenate([one, alone]), followed)


def _parts(t: Tables, w: Words, allowed: tuple[np.ndarray, np.ndarray], some: np.ndarray, from_end: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ends (or beginnings) of the distinct words ``some`` that are ``allowed`` words: where each word's stand, how many they are, and their numbers."""
    at, size = w.at[w.one], w.size[w.one]
    whose, number = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n in allowed[1]:
        some = some[size[some] >= n]
        found = t.words(w.eights, at[some] + (size[some] - n if from_end else 0), np.full(len(some), n))
        ok = np.flatnonzero(found >= 0)
        ok = ok[allowed[0][found[ok]]]
        whose.append(some[ok])
        number.append(found[ok])
    whose, number = np.concatenate(whose), np.concatenate(number)
    order = np.argsort(whose, kind="stable")
    count = np.bincount(whose, minlength=len(w.one))
    return np.cumsum(count) - count, count, number[order]


def hits(t: Tables, data: np.ndarray, offsets: np.ndarray, whole_only: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``text, theme`` of the texts between ``offsets``, each once, sorted by text: the theme as a place in ``t.themes``.

    Texts that are ``whole_only`` meet no pairs.
    """
    n_blocks = len(t.themes) // 64 + 1
    w = cut(data, offsets, t.longest)

    def cells(text, keyword):
        count = t.of[keyword + 1] - t.of[keyword]
        found = []
        for part in portions(count):
            entry, of = ranges(t.of[keyword[part]], count[part])
            found.append(merged(text[part][of] * n_blocks + t.block[entry], t.mask[entry]))
        return merged(*(np.concatenate(x) for x in zip(*found)))

    fits = w.size[w.one] <= t.longest
    number = np.full(len(w.one), -1, np.int64)
    number[fits] = t.words(w.eights, w.at[w.one[fits]], w.size[w.one[fits]])
    keyword = number[w.which]
    met = np.flatnonzero(keyword >= 0)
    cell, mask = cells(w.text[met], keyword[met])
    if len(t.pairs):
        # a text that has every theme can gain nothing
        done = np.bincount(cell // n_blocks, np.bitwise_count(mask), len(offsets) - 1) == len(t.themes)
        i = w.followed[~(done | whole_only)[w.text[w.followed]]]
        a, b = w.which[i], w.which[i + 1]
        a_at, a_count, a_number = _parts(t, w, t.begins, np.unique(a), True)
        b_at, b_count, b_number = _parts(t, w, t.ends, np.unique(b), False)
        count = a_count[a] * b_count[b]
        i, a, b, count = (x[count > 0] for x in (i, a, b, count))
        found = [(cell, mask)]
        for part in portions(count):
            k, of = ranges(np.zeros(len(part), np.int64), count[part])
            x, y = a[part][of], b[part][of]
            keyword = t.found_pairs(pair_key(a_number[a_at[x] + k // b_count[y]], b_number[b_at[y] + k % b_count[y]]))
            met = np.flatnonzero(keyword >= 0)
            found.append(cells(w.text[i[part]][of[met]], keyword[met]))
        cell, mask = merged(*(np.concatenate(x) for x in zip(*found)))
    at, bit = np.nonzero(np.unpackbits(mask.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return cell[at] // n_blocks, cell[at] % n_blocks * 64 + bit


def matched(batches: Iterator[pa.RecordBatch], t: Tables) -> Iterator[pa.RecordBatch]:
    """Of batches of key columns, the text and whether only whole words count: the key and the list of themes of each text that has one."""
    for batch in batches:
        texts = batch.column(batch.num_columns - 2).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
        data = _bytes(texts.buffers()[2])[offsets[0]:offsets[-1]]
        text, theme = hits(t, data, offsets - offsets[0], batch.column(batch.num_columns - 1).to_numpy(zero_copy_only=False))
        rows, first = np.unique(text, return_index=True)
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(text)), pa.int32()), t.themes.take(pa.array(theme)))
        rows = pa.array(rows)
        yield pa.RecordBatch.from_arrays([*(c.take(rows) for c in batch.columns[:-2]), lists], [*batch.schema.names[:-2], "__themes"])
