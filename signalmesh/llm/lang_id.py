"""Operator 4: language identification with a linear-chain conditional random field over words.

Every word of a text gets a distribution over languages by forward-backward:
emission scores are sums of learned weights of its affixes, character n-grams
and lexicon features, and learned transitions between neighbouring words let
context decide in code-switched text.  A chain is a run of words of one line
(at most ``CHAIN`` words; longer lines are several chains).  A document's
prediction is the language with the largest mean marginal over its words that
hold letters, and that mean is the score.

The model is fitted on a bounded sample of labelled documents that are not
held out: ``TRAIN_DOCS`` documents a language, of their lines ``TRAIN_LINES`` a
language, both by smallest hash (so a lost task picks the same again).  Half the
training chains are spliced from two languages, as lines of one language alone
teach nothing about switches.  Scoring is one narrow pass over whole texts.

Defined results: null text or text without a letter is ``und`` with score 0, as
is every text when nothing labelled is there to learn from; a null ``doc_id``
counts as the empty text in the hold-out rule; ties go to the smaller language
code; repeated rows are scored each; an empty table gives no rows.
"""

from __future__ import annotations

import array
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmesh.llm.common import documents, ship, table, with_rid

CHAIN, BITS = 64, 17
TRAIN_DOCS, TRAIN_LINES, EPOCHS = 300, 1500, 20
#: A text of which no language holds this share of the words is rejected by the filter.
AT_LEAST = 0.3
#: A word that is seen this often in a language's sample is in its lexicon.
LEXICON = 3
#: Words whose emissions a worker keeps (a memory bound only).
CACHED = 300_000
#: Words scored, or trained on, together.
BLOCK = 60_000

OUT = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def _plain(word: str) -> str:
    word = word.lower()
    if word.isalpha():
        return word
    return "".join(c for c in word if c.isalpha())


def features(word: str) -> list[int]:
    """Hashed affixes, n-grams and the word itself; none for a word without letters."""
    w = _plain(word)
    if not w:
        return []
    edged = f"^{w}$"
    names = [f"p{w[:n]}" for n in (1, 2, 3)] + [f"s{w[-n:]}" for n in (1, 2, 3)] + [f"w{w}"]
    names += [edged[i: i + 3] for i in range(len(edged) - 2)] + [edged[i: i + 2] for i in range(len(edged) - 1)]
    mask = (1 << BITS) - 1
    return [zlib.crc32(n.encode()) & mask for n in names]


def chains_of(line: str) -> Iterator[list[str]]:
    words = line.split()
    for at in range(0, len(words), CHAIN):
        yield words[at: at + CHAIN]


def marginals(emit: np.ndarray, lengths: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of chains laid end to end: word marginals, summed pair marginals, log-likelihood normalisers.

    Chains are worked side by side, longest first, so step t only touches chains that reach it.
    """
    n, labels = len(lengths), emit.shape[1]
    order = np.argsort(-lengths, kind="stable")
    starts = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    live = [int(np.searchsorted(-sizes, -t, side="right")) for t in range(1, int(sizes[0]) + 1)] if n else []
    peak = emit.max(axis=1, keepdims=True)
    p, a = np.exp(emit - peak), np.exp(trans)
    forward, scale = np.empty_like(p), np.empty(len(p))
    for t, m in enumerate(live):
        at = starts[:m] + t
        f = p[at] if t == 0 else (forward[at - 1] @ a) * p[at]
        s = f.sum(axis=1)
        forward[at], scale[at] = f / s[:, None], s
    backward, pairs = np.ones_like(p), np.zeros((labels, labels))
    for t in range(len(live) - 2, -1, -1):
        at = starts[: live[t + 1]] + t
        right = p[at + 1] * backward[at + 1] / scale[at + 1][:, None]
        backward[at] = right @ a.T
        pairs += a * (forward[at].T @ right)
    return forward * backward, pairs, np.log(scale) + peak[:, 0]


class Model:
    """Emission weights per hashed feature and language, lexicons, transitions."""

    def __init__(self, labels: list[str], weights: np.ndarray, lexicon: dict[str, int], lexicon_weights: np.ndarray, trans: np.ndarray):
        self.labels, self.weights, self.lexicon, self.lexicon_weights, self.trans = labels, weights, lexicon, lexicon_weights, trans
        self.cache = None

    def emissions(self, words: list[str]) -> np.ndarray:
        flat, counts = [], []
        for w in words:
            f = features(w)
            flat += f
            counts.append(len(f))
        counts = np.array(counts)
        out = np.zeros((len(words), len(self.labels)))
        some = counts > 0
        if some.any():
            out[some] = np.add.reduceat(self.weights[flat], (np.cumsum(counts) - counts)[some], axis=0)
        out += self.lexicon_weights[[self.lexicon.get(_plain(w), 0) for w in words]]
        return out


def _lexicon(vocabulary: dict[str, int], word_at: np.ndarray, truth: np.ndarray) -> tuple[dict[str, int], int, np.ndarray]:
    """The set (of languages whose sample has it often) of each plain word, how many sets there are, and every word's set (0: none)."""
    plain: dict[str, int] = {}
    plain_at = np.array([plain.setdefault(_plain(w), len(plain)) for w in vocabulary], dtype=np.int64)
    names = list(plain)
    pairs, seen = np.unique(truth.astype(np.int64) * len(plain) + plain_at[word_at], return_counts=True)
    member: dict[str, int] = {}
    for at in pairs[seen >= LEXICON].tolist():
        k, w = at // len(plain), names[at % len(plain)]
        if w:
            member[w] = member.get(w, 0) | 1 << k
    sets = {bits: i + 1 for i, bits in enumerate(sorted(set(member.values())))}
    lexicon = {w: sets[bits] for w, bits in member.items()}
    return lexicon, len(sets), np.array([lexicon.get(w, 0) for w in names], dtype=np.int64)[plain_at]


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, seed: int = 7, rate: float = 0.3, decay: float = 1e-4,
          block: int = BLOCK) -> Model:
    """Fit by full-batch Adagrad on the chains' conditional log-likelihood. ``rows``: (language, line).

    Marginals are worked out for chains of about ``block`` words at a time, features for an eighth
    as many, so that the sample is held as a few numbers a word and a feature of a distinct word.
    """
    labels = sorted({lang for lang, _ in rows})
    number = {lang: k for k, lang in enumerate(labels)}
    rng = np.random.default_rng(seed)
    vocabulary: dict[str, int] = {}
    word_at, truth, lengths = array.array("i"), array.array("i"), array.array("i")  # chains end to end, each word once as a string
    for lang, line in sorted(rows):
        for c in chains_of(line):
            word_at.extend([vocabulary.setdefault(w, len(vocabulary)) for w in c])
            truth.extend([number[lang]] * len(c))
            lengths.append(len(c))
    starts, pure = np.cumsum(lengths) - lengths, len(lengths)
    lexicon, sets, in_set = _lexicon(vocabulary, np.array(word_at), np.array(truth))
    for i, j in rng.permutation(pure)[: pure // 2 * 2].reshape(-1, 2):  # spliced: code-switched by construction
        left = slice(starts[i], starts[i] + rng.integers(1, lengths[i] + 1))
        right = slice(starts[j] + rng.integers(0, lengths[j]), starts[j] + lengths[j])
        lengths.append(left.stop - left.start + right.stop - right.start)
        for part in (left, right):
            word_at.extend(word_at[part])
            truth.extend(truth[part])
    word_at, truth, lengths = np.array(word_at), np.array(truth), np.array(lengths, dtype=np.int64)
    flat, per_word = array.array("i"), array.array("i")
    for w in vocabulary:
        f = features(w)
        flat.extend(f)
        per_word.append(len(f))
    flat, per_word, size = np.array(flat), np.array(per_word, dtype=np.int64), len(labels)
    ahead, few = np.r_[0, np.cumsum(per_word)], max(1, block // 8)
    vocabulary.clear()

    def featured() -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Some words at a time: which they are, the features of all, and whose each is (from the first of them)."""
        for lo in range(0, len(per_word), few):
            n = per_word[lo: lo + few]
            yield slice(lo, lo + len(n)), flat[ahead[lo]: ahead[lo + len(n)]], np.repeat(np.arange(len(n)), n)

    weights, lex, trans = np.zeros((1 << BITS, size)), np.zeros((sets + 1, size)), np.zeros((size, size))
    ends = np.cumsum(lengths)
    cuts = np.flatnonzero(np.diff((ends - lengths) // block)) + 1
    blocks = [(int(lo), int(hi), int(ends[lo] - lengths[lo]), int(ends[hi - 1])) for lo, hi in zip([0, *cuts], [*cuts, len(lengths)]) if hi]
    seen_pairs = np.zeros((size, size))
    for lo, hi, first, end in blocks:
        inner = np.ones(end - first, dtype=bool)
        inner[ends[lo:hi] - 1 - first] = False  # a chain's last word has no successor
        at = first + np.flatnonzero(inner)
        seen_pairs += np.bincount(truth[at] * size + truth[at + 1], minlength=size * size).reshape(size, size)
    sums = [np.full_like(x, 1e-8) for x in (weights, lex, trans)]
    for _ in range(epochs):
        by_word = lex[in_set]
        for words, of, owner in featured():
            by_word[words] += np.stack([np.bincount(owner, weights[of, k], len(by_word[words])) for k in range(size)], 1)
        per, pairs = np.zeros((len(per_word), size)), np.zeros((size, size))
        for lo, hi, first, end in blocks:
            own = word_at[first:end]
            marg, part, _ = marginals(by_word[own], lengths[lo:hi], trans)
            pairs += part
            marg[np.arange(end - first), truth[first:end]] -= 1
            for k in range(size):
                per[:, k] -= np.bincount(own, marg[:, k], len(per_word))
        up = -decay * len(truth) * 1e-3 * weights
        for words, of, owner in featured():
            for k in range(size):
                up[:, k] += np.bincount(of, per[words, k][owner], 1 << BITS)
        grads = (up, np.stack([np.bincount(in_set, per[:, k], sets + 1) for k in range(size)], 1), seen_pairs - pairs)
        for x, g, s in zip((weights, lex, trans), grads, sums):
            s += g * g
            x += rate * g / np.sqrt(s)
    lex[0] = 0
    return Model(labels, weights.astype(np.float32), lexicon, lex, trans)


class _Emissions(dict):
    """word -> row of a table of emissions that grows as words are met."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.new, self.table = model, [], np.zeros((0, len(model.labels)))

    def __missing__(self, word: str) -> int:
        at = self[word] = len(self)
        self.new.append(word)
        return at

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self) > CACHED:
            self.clear()
            self.table = self.table[:0]
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        if self.new:
            self.table = np.concatenate([self.table, self.model.emissions(self.new)])
            self.new = []
        return self.table[at]


def _worker_emissions(model: Model) -> _Emissions:
    """A Python worker's tasks share the broadcast model, and so what was worked out with it."""
    if model.cache is None:
        model.cache = _Emissions(model)
    return model.cache


def _score_block(block: list[tuple], emissions: _Emissions) -> tuple[list, list, list]:
    labels = emissions.model.labels
    words, lengths, owner = [], [], []
    for i, (_, text) in enumerate(block):
        for line in (text or "").split("\n"):
            for chain in chains_of(line):
                words += chain
                lengths.append(len(chain))
                owner.append(i)
    lettered = np.array([any(map(str.isalpha, text or "")) for _, text in block])
    mean = np.zeros((len(block), max(len(labels), 1)))
    if words and labels:
        emit = emissions.rows(words)
        lengths_ = np.array(lengths, dtype=np.int64)
        marg, _, _ = marginals(emit, lengths_, emissions.model.trans)
        told = np.abs(emit).max(axis=1) > 0  # words that say something
        doc = np.repeat(np.array(owner), lengths_)
        for told_only in (True, False):  # texts of unknown words alone count all their words
            use = told if told_only else np.ones_like(told)
            n = np.bincount(doc[use], minlength=len(block))
            total = np.stack([np.bincount(doc[use], marg[use, k], len(block)) for k in range(len(labels))], 1)
            empty = (mean.sum(axis=1) == 0) & (n > 0)
            mean[empty] = total[empty] / n[empty][:, None]
    best = mean.argmax(axis=1)
    known = lettered & bool(labels)
    return ([d for d, _ in block], [labels[b] if k else "und" for b, k in zip(best, known)],
            [min(1.0, float(mean[i, b])) if k else 0.0 for i, (b, k) in enumerate(zip(best, known))])


def _predict(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    emissions = _worker_emissions(model)
    block, weight = [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(_score_block(block, emissions), OUT)], schema=OUT)

    for doc_id, text in documents(batches, "doc_id", "text"):
        block.append((doc_id, text))
        weight += len(text or "") // 6 + 1
        if weight >= BLOCK:
            yield out()
            block, weight = [], 0
    if block:
        yield out()


def _by_weight(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    """Slices of about ``BLOCK`` words (a longer text is a slice's last row)."""
    words = pc.fill_null(pc.binary_length(batch[text]), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 6 + 1
    ends = np.flatnonzero(np.diff((np.cumsum(words) - words) // BLOCK)) + 1
    for lo, hi in zip([0, *ends], [*ends, batch.num_rows]):
        yield batch.slice(int(lo), int(hi - lo))


def sample(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> list[tuple[str, str]]:
    """The bounded training sample, as (language, line). ``docs``: doc_id, text, lang."""
    labelled = with_rid(docs).filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    first = Window.partitionBy("lang").orderBy("place", "__rid")
    chosen = (labelled.select("__rid", "lang", F.xxhash64(F.col("doc_id"), F.lit(1)).alias("place"))
              .withColumn("n", F.row_number().over(first)).filter(F.col("n") <= train_docs).select("__rid"))
    lines = (labelled.join(F.broadcast(chosen), "__rid", "left_semi")  # at most train_docs rows a language
             .select("lang", "__rid", F.posexplode(F.split("text", "\n")).alias("at", "line")).filter("trim(line) <> ''")
             .withColumn("place", F.xxhash64("__rid", "at")))
    nth = Window.partitionBy("lang").orderBy("place", "at", "line")
    rows = lines.withColumn("n", F.row_number().over(nth)).filter(F.col("n") <= train_lines).select(
        "lang", F.substring("line", 1, 4000).alias("line"))
    return [tuple(r) for r in rows.collect()]


def fitted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS,
           train_lines: int = TRAIN_LINES):
    """The broadcast model of a bounded sample of ``docs`` (of fixed size, whatever theirs)."""
    ship(docs.sparkSession)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"),
                       F.col(lang).cast("string").alias("lang"))
    lines = sample(rows, train_docs, train_lines)
    none = Model([], np.zeros((1, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)))
    return docs.sparkSession.sparkContext.broadcast(train(lines) if lines else none)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", train_docs: int = TRAIN_DOCS,
             train_lines: int = TRAIN_LINES) -> DataFrame:
    """One row per input row: ``doc_id, held_out, lang_pred, score`` 

    ``train_docs`` and ``train_lines`` bound the sample the driver fits on; a
    training line counts up to 4000 characters.
    """
    model = fitted(docs, doc_id, text, lang, train_docs, train_lines)
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return (rows.mapInArrow(lambda b: _predict(b, model.value), "doc_id long, lang_pred string, score double")
            .select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score"))


def keep_identified(docs: DataFrame, at_least: float = AT_LEAST, text: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text has a language with a score of ``at_least``.

    What goes: null texts, texts without letters, and texts of which no
    language holds even ``at_least`` of the words.  Code-switched texts stay.
    """
    model = fitted(docs, text=text, **how)

    def kept(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _by_weight(batch, text):
                _, pred, score = _score_block([(None, t) for t in part[text].to_pylist()], _worker_emissions(model.value))
                yield part.filter(pa.array([p != "und" and s >= at_least for p, s in zip(pred, score)], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def op4_lang_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all ``documents``."""
    return identify(table(spark, sf_dir, "documents"))
