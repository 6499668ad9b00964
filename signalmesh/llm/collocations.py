"""Operator 13: phrase collocations by multikey three-way quicksort of suffix pointers.

Every word starts a suffix of at most three words that ends with its piece.
Workers put equal suffixes of a stretch of text together (a weight each), and
the weighted suffixes are routed by their leading words, so that equal phrases
meet.  A task sorts pointers to its suffixes by multikey three-way quicksort:
partitions are parted into smaller, equal and larger at the word of their
depth, and the equal part goes on one word deeper, to the maximum depth.  The weight of
an equal partition is its phrase's count there.  A partition too light for a
candidate is abandoned.  All partitions of a round are parted together with
array operations, and those of a few pointers are sorted out at once.

Routing is global, in two rounds.  Suffixes of two words are routed by the first and by
one of ``SALTS`` shares of the second, so a word pair lies in one task and no
hot word in one task alone; a word's weights are added up.  Suffixes of three
words are routed only where both of their word pairs are frequent, as the others are abandoned
already, by the two leading words and a share of the third.  Workers know the
frequent pairs by a Bloom filter of at most ``MOST_BITS`` bits: it never misses one, and an infrequent pair that it
lets pass is counted and abandoned later, so it decides nothing.

A candidate's parts are at least as frequent as the candidate, so scores come
from joins among the frequent phrases alone.  Arithmetic is in decimals of 38 digits
(exact while counts are below 10^16); scores are at most one million.

Defined results: null texts are empty; null languages are ``und``; repeated rows
count each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmesh.llm.common import documents, table, texts, written

LEAST, SHARE, TOP, SCALE = 10, 50, 2000, 1_000_000
SALTS = 16
#: Words a worker puts together, bytes of text whose suffixes a sorting task holds, and pointers of a partition that is sorted out at once.
STRETCH, TASK_BYTES, FEW = 1 << 19, 3 << 20, 1000
#: Bits of the filter a frequent pair (4 of them are its own), and of the filter at most.
BITS_EACH, HASHES, MOST_BITS = 16, 4, 1 << 27
#: Bytes that end a piece.
ENDS = b".,;:!?\n\x0b\x0c\r"
TO_LINES = bytes.maketrans(ENDS, b"\n" * len(ENDS))

SUFFIXES = pa.schema([("lang", pa.string()), ("w1", pa.string()), ("w2", pa.string()), ("w3", pa.string()), ("n", pa.int64())])
SUFFIXES_SQL = "lang string, w1 string, w2 string, w3 string, n long"


class _Numbers(dict):
    """Numbers from 1, in order of appearance."""

    def __missing__(self, key):
        self[key] = n = len(self) + 1
        return n


def _run_ends(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal rows begin."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for k in sorted_keys:
        new[1:] |= k[1:] != k[:-1]
    return np.flatnonzero(new)


class Stretch:
    """Words of some texts as numbers; a zero and a zero end a piece."""

    def __init__(self):
        self.words, self.langs = _Numbers(), _Numbers()
        self.at: list[int] = []
        self.spans: list[tuple[int, int]] = []

    def add(self, lang: str, text: str) -> None:
        start, number = len(self.at), self.words.__getitem__
        # bytes.lower() knows A-Z only; what bytes.split() cuts at besides space and tab ends a piece
        for piece in text.encode().lower().translate(TO_LINES).split(b"\n"):
            words = piece.split()
            if words:
                self.at.extend(map(number, words))
                self.at += (0, 0)
        self.spans.append((self.langs[lang], len(self.at) - start))

    def batch(self, pairs: Filter | None) -> pa.RecordBatch:
        """Weighted suffixes of two words, or with the frequent ``pairs`` those of three that may be frequent."""
        w = np.array(self.at + [0, 0], np.int64)
        lang = np.repeat(*np.array(self.spans, np.int64).T)
        p = np.flatnonzero(w[: len(lang)])
        if pairs is not None:
            words, langs = (np.array([0, *map(_hash, x)], np.uint64) for x in (self.words, self.langs))
            frequent = np.zeros(len(w), bool)
            p = p[w[p + 1] > 0]
            frequent[p] = pairs.holds(pair_hash(langs[lang[p]], words[w[p]], words[w[p + 1]]))
            p = p[frequent[p] & frequent[p + 1]]
        w1, w2, w3, lang = w[p], w[p + 1], w[p + 2], lang[p]
        if pairs is None:
            w3 = np.zeros_like(w3)
        if pairs is None and len(self.words) < 1 << 21 and len(self.langs) < 1 << 20:  # three numbers in one sort faster
            packed = np.sort(lang << 42 | w1 << 21 | w2)
            keys = [packed >> 42, packed >> 21 & 0x1FFFFF, packed & 0x1FFFFF, w3]
            first = _run_ends(packed)
        else:
            order = np.lexsort((w3, w2, w1, lang))
            keys = [k[order] for k in (lang, w1, w2, w3)]
            first = _run_ends(*keys)
        words = pa.array([None, *self.words], pa.binary()).cast(pa.string())
        langs = pa.array([None, *self.langs], pa.string())
        columns = [source.take(pa.array(k[first])) for source, k in zip((langs, words, words, words), keys)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(np.diff(np.r_[first, len(p)]).astype(np.int64))], schema=SUFFIXES)


def _hash(word: bytes | str) -> int:
    return xxhash.xxh3_64_intdigest(word)


def pair_hash(lang: np.ndarray, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """One hash of three columns of hashes."""
    h = lang
    for part in (first, second):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x9E3779B97F4A7C15) + part
    return (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)


class Filter:
    """Bloom filter of word pairs; its number of bits is a power of two."""

    def __init__(self, bits: int):
        self.words = np.zeros(bits // 64, np.uint64)

    @staticmethod
    def size(n: int) -> int:
        """Bits for ``n`` pairs."""
        return min(max(1 << (n * BITS_EACH).bit_length(), 1 << 10), MOST_BITS)

    @staticmethod
    def places(hashes: np.ndarray, bits: int) -> Iterator[np.ndarray]:
        low, high = hashes & np.uint64(0xFFFFFFFF), (hashes >> np.uint64(32)) | np.uint64(1)
        for k in range(HASHES):
            yield (low + np.uint64(k) * high) & np.uint64(bits - 1)

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self.places(hashes, 64 * len(self.words)):
            out &= self.words[at >> np.uint64(6)] >> (at & np.uint64(63)) & np.uint64(1) == 1
        return out


def _filter_words(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """The words of the filter that some pairs set bits in."""
    for batch in batches:
        hashes = [np.fromiter(map(_hash, batch[c].to_pylist()), np.uint64, batch.num_rows) for c in ("lang", "w1", "w2")]
        for at in Filter.places(pair_hash(*hashes), bits):
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(6)).astype(np.int64)),
                                              pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))], names=["word", "bits"])


def pair_filter(pairs: DataFrame) -> Filter:
    """The filter of the rows ``lang, w1, w2``; its size is bounded, whatever their number."""
    out = Filter(Filter.size(pairs.count()))
    bits = 64 * len(out.words)
    set_ = pairs.mapInArrow(lambda b: _filter_words(b, bits), "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    out.words[set_["word"].to_numpy()] = set_["bits"].to_numpy().view(np.uint64)
    return out


def _suffixes(batches: Iterable[pa.RecordBatch], stretch: int, pairs=None) -> Iterator[pa.RecordBatch]:
    s = Stretch()
    for lang, text in documents(batches, "lang", "text"):
        s.add(lang, text)
        if len(s.at) >= stretch:
            yield s.batch(pairs and pairs.value)
            s = Stretch()
    if s.at:
        yield s.batch(pairs and pairs.value)


def equal_partitions(words: list[np.ndarray], weight: np.ndarray, least: int, few: int = FEW) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Multikey three-way quicksort of pointers: ``depth, pointers, weights`` of equal partitions.

    ``words[d]`` holds the words at depth ``d`` (0: none, the suffix has ended).
    A partition is given by one of its pointers and its weight.  At the last
    depth those lighter than ``least`` are left out.
    """
    last = len(words) - 1
    at = np.flatnonzero(words[0])
    sizes, depths = np.array([len(at)]), np.array([0])
    while len(at):
        # a deepest partition that is too light holds no candidate
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        keep = (depths < last) | (np.add.reduceat(weight[at], starts) >= least)
        small = keep & (sizes <= few)
        if small.any():
            yield from _sorted_out(words, weight, at[np.repeat(small, sizes)], np.repeat(np.flatnonzero(small), sizes[small]),
                                   np.repeat(depths[small], sizes[small]), least)
        keep &= ~small
        at, sizes, depths = at[np.repeat(keep, sizes)], sizes[keep], depths[keep]
        if not len(at):
            return
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        part, depth = np.repeat(np.arange(len(sizes)), sizes), np.repeat(depths, sizes)
        word = np.choose(depth, [w[at] for w in words])
        a, b, c = word[starts], word[starts + sizes // 2], word[starts + sizes - 1]
        pivot = np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c))[part]  # the median of three
        side = 3 * part + (1 + np.sign(word - pivot))
        order = np.argsort(side, kind="stable")
        at, side = at[order], side[order]
        first = _run_ends(side)
        kind, d = side[first], depths[side[first] // 3]
        weights = np.add.reduceat(weight[at], first)
        equal = (kind % 3 == 1) & (np.choose(d, [w[at[first]] for w in words]) > 0)
        for k in range(last + 1):
            mine = equal & (d == k) & ((k < last) | (weights >= least))
            if mine.any():
                yield k, at[first[mine]], weights[mine]
        sizes = np.diff(np.r_[first, len(at)])
        depths = np.where(kind % 3 == 1, d + 1, d)
        # equal partitions of suffixes that have ended, or at the last depth, are done
        go_on = (kind % 3 != 1) | (equal & (d < last))
        at, sizes, depths = at[np.repeat(go_on, sizes)], sizes[go_on], depths[go_on]


def _sorted_out(words, weight, at, part, depth, least) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """The equal partitions below small ones, whose pointers are sorted together."""
    last = len(words) - 1
    order = np.lexsort([w[at] for w in reversed(words)] + [part])
    at, part, depth = at[order], part[order], depth[order]
    keys = [part]
    for k in range(last + 1):
        keys.append(words[k][at])
        first = _run_ends(*keys)
        weights = np.add.reduceat(weight[at], first)
        mine = (words[k][at[first]] > 0) & (depth[first] <= k) & ((k < last) | (weights >= least))
        if mine.any():
            yield k, at[first[mine]], weights[mine]


def _counted(batches: Iterable[pa.RecordBatch], least: int, size: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of a task's suffixes of ``size`` words: of two words and one, or of three."""
    held = [b for b in batches if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held).combine_chunks()
    n = len(t)
    coded = pa.concat_arrays([t[c].chunk(0) for c in ("w1", "w2", "w3")[:size]]).dictionary_encode()
    codes = coded.indices.fill_null(-1).to_numpy().astype(np.int64) + 1
    langs = t["lang"].chunk(0).dictionary_encode()
    words = [codes[k * n: (k + 1) * n] for k in range(size)]
    n_words = len(coded.dictionary) + 1
    # the language leads: at depth 0 a word is a language and a word
    words[0] = langs.indices.to_numpy().astype(np.int64) * n_words + words[0]
    vocabulary = pa.concat_arrays([pa.nulls(1, pa.string()), coded.dictionary])
    for depth, at, weights in equal_partitions(words, t["n"].to_numpy(), least):
        if size == 3 and depth < 2:
            continue
        lang = langs.dictionary.take(pa.array(words[0][at] // n_words))
        said = [vocabulary.take(pa.array(words[k][at] % n_words if k <= depth else np.zeros(len(at), np.int64))) for k in range(size)]
        yield pa.RecordBatch.from_arrays([lang, *said, *[pa.nulls(len(at), pa.string())] * (3 - size), pa.array(weights)], schema=SUFFIXES)


def phrase_counts(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST,
                  stretch: int = STRETCH, task_bytes: int = TASK_BYTES) -> tuple[DataFrame, DataFrame]:
    """``lang, w1, w2, w3, n``: phrases of one to three words (later words null) that occur ``least`` times; and ``lang, n``: all words."""
    spark = docs.sparkSession
    rows = texts(docs.withColumn("__id", F.lit(0)), "__id", text, lang=lang).select(
        F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    n_bytes = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    tasks = max(n_bytes // task_bytes + 1, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def routed(size: int, pairs=None) -> DataFrame:
        leading, last = ["lang", "w1", "w2"][:size], f"w{size}"  # the words before the last one lead
        suffixes = rows.mapInArrow(lambda b: _suffixes(b, stretch, pairs), SUFFIXES_SQL)
        return (suffixes.repartition(tasks, *leading, F.pmod(F.xxhash64(last), F.lit(SALTS)))
                .mapInArrow(lambda b: _counted(b, least, size), SUFFIXES_SQL))

    short = written(routed(2), "phrase-pairs")
    pairs = short.filter("w2 is not null")
    long = written(routed(3, spark.sparkContext.broadcast(pair_filter(pairs))), "phrase-triples")
    words = short.filter("w2 is null").groupBy("lang", "w1", "w2", "w3").agg(F.sum("n").alias("n"))
    totals = short.filter("w2 is null").groupBy("lang").agg(F.sum("n").alias("n"))
    return words.filter(F.col("n") >= least).unionByName(pairs).unionByName(long), totals


def _floor_score(a: Column, left: Column, right: Column) -> Column:
    wide = lambda c: c.cast("decimal(16,0)")
    square = (wide(a) * wide(a)).cast("decimal(32,0)") * F.lit(SCALE).cast("decimal(7,0)")
    return F.call_function("div", square.cast("decimal(38,0)"), (wide(left) * wide(right)).cast("decimal(38,0)"))


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, share: int = SHARE, top: int = TOP,
                 stretch: int = STRETCH, task_bytes: int = TASK_BYTES) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``top`` phrases of two to three words of each language."""
    counts, totals = phrase_counts(docs, text, lang, least, stretch, task_bytes)
    # words hold no space, so a space joins them without doubt
    f = counts.select("lang", F.concat_ws(" ", "w1", "w2", "w3").alias("phrase"), "w1", "w2", "w3", F.col("n").alias("a"))
    longer = F.col("w3").isNotNull()
    inner = (f.filter(longer).select("lang", F.explode(F.array(F.concat_ws(" ", "w1", "w2"), F.concat_ws(" ", "w2", "w3"))).alias("phrase"), "a")
             .groupBy("lang", "phrase").agg(F.max("a").alias("within")))
    kept = (f.filter("w2 is not null").join(inner, ["lang", "phrase"], "left")
            .filter(longer | F.col("within").isNull() | (100 * F.col("within") < share * F.col("a"))))
    cut = lambda k, left, right: F.struct(F.lit(k).alias("k"), left.alias("left"), right.alias("right"))
    two = F.array(cut(1, F.col("w1"), F.col("w2")))
    three = F.array(cut(1, F.col("w1"), F.concat_ws(" ", "w2", "w3")), cut(2, F.concat_ws(" ", "w1", "w2"), F.col("w3")))
    cuts = kept.select("lang", "phrase", "a", F.explode(F.when(longer, three).otherwise(two)).alias("c")).select("lang", "phrase", "a", "c.*")
    of = lambda by, name: f.select("lang", F.col("phrase").alias(by), F.col("a").alias(name))
    scored = cuts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    scored = scored.withColumn("score", _floor_score(F.col("a"), F.col("l"), F.col("r")))
    lowest = (scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
              .select("lang", "phrase", "a", "c.l", "c.r", "c.score"))
    first = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(first).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 2000 strongest phrases of every language of all ``documents``."""
    return collocations(table(spark, sf_dir, "documents"))


#: The same in DuckDB.
ORACLE_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
grams AS (SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
          FROM starts, (SELECT unnest([1, 2, 3]) AS size) WHERE i + size - 1 <= len(w)),
f AS (SELECT lang, size, phrase, count(*) AS f FROM grams GROUP BY ALL),
words AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE size = 1 GROUP BY lang),
c AS (SELECT lang, size, phrase, f AS a, string_split(phrase, ' ') AS p FROM f WHERE size > 1 AND f >= 10),
inner_ AS (SELECT lang, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS phrase, a FROM c WHERE size = 3),
kept AS (SELECT c.* FROM c LEFT JOIN (SELECT lang, phrase, max(a) AS within_ FROM inner_ GROUP BY ALL) x
           ON c.lang = x.lang AND c.phrase = x.phrase AND c.size = 2
         WHERE x.within_ IS NULL OR 100 * x.within_ < 50 * c.a),
cuts AS (SELECT *, unnest(range(1, size)) AS k FROM kept),
scored AS (
  SELECT u.lang, u.phrase, u.a, u.k, x.f AS l, y.f AS r,
         ((1000000::HUGEINT * u.a * u.a) // (x.f::HUGEINT * y.f))::BIGINT AS score
  FROM cuts u
  JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(u.p[1:u.k], ' ')
  JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(u.p[u.k + 1:u.size], ' ')),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, n.n, r.score
FROM ranked r JOIN words n ON n.lang = r.lang WHERE r.rank <= 2000
"""
