import numpy as np
import pyarrow as pa
import tracemalloc
import zlib

from signalmesh.llm import lang_id
from signalmesh.llm.lang_id import identify, marginals, op4_lang_id, train
from tests.llm.fixtures import SF2, documents, odd_documents


def test_forward_backward_equals_enumeration():
    from itertools import product

    rng = np.random.default_rng(1)
    lengths = np.array([3, 1, 4])
    emit, trans = rng.normal(size=(8, 3)), rng.normal(size=(3, 3))
    got, pairs, norm = marginals(emit, lengths, trans)
    want, want_pairs, at = np.zeros_like(emit), np.zeros((3, 3)), 0
    for n in lengths:
        paths = list(product(range(3), repeat=int(n)))
        w = np.exp([sum(emit[at + i, k] for i, k in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(norm[at: at + n].sum(), np.log(w.sum()))
        for p, x in zip(paths, w / w.sum()):
            for i, k in enumerate(p):
                want[at + i, k] += x
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += x
        at += n
    assert np.allclose(got, want) and np.allclose(pairs, want_pairs)


def test_switches_inside_a_line():
    model = train([("de", "der hund und die katze")] * 8 + [("en", "the dog and the cat")] * 8, epochs=40)
    words = "the dog und die katze".split()
    marg, _, _ = marginals(model.emissions(words), np.array([5]), model.trans)
    assert [model.labels[k] for k in marg.argmax(1)] == ["en", "en", "de", "de", "de"]


def _sample(lines: int, words: int) -> list[tuple[str, str]]:
    rng = np.random.default_rng(3)
    return [(lang, " ".join(f"{lang}{x:04d}" for x in rng.integers(0, words, 60))) for lang in ("aa", "bb", "cc") for _ in range(lines)]


def test_training_in_blocks_is_the_same_model():
    rows = _sample(20, 300) + [("aa", "12 34"), ("cc", "\t")]
    whole, parts = train(rows, epochs=5, block=1 << 30), train(rows, epochs=5, block=70)
    assert whole.labels == parts.labels and whole.lexicon == parts.lexicon
    for x, y in ((whole.weights, parts.weights), (whole.lexicon_weights, parts.lexicon_weights), (whole.trans, parts.trans)):
        assert np.allclose(x, y, atol=1e-6)


def test_training_memory_is_a_few_bytes_a_word():
    rows = _sample(1500, 9000)  # 270,000 words, of them 27,000 distinct ones
    tracemalloc.start()
    try:
        train(rows, epochs=1)
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in documents(spark, SF2).collect()}
    got = op4_lang_id(spark, SF2).collect()
    assert len(got) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(truth[r.doc_id] == r.lang_pred for r in held) >= 0.97 * len(held)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = identify(docs).collect()
    assert len(got) == docs.count()
    for r, text in zip(got, [x.text for x in docs.collect()]):
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, text or "")))
    assert identify(docs.limit(0)).count() == 0
    unlabelled = docs.drop("lang").selectExpr("*", "cast(null as string) lang")
    assert {r.lang_pred for r in identify(unlabelled).collect()} == {"und"}


def test_slices_by_weight():
    column = ["x" * 900_000, "b", None, "", "y" * 500_000] + ["w " * 3000] * 100
    parts = list(lang_id._by_weight(pa.record_batch({"t": pa.array(column)}), "t"))
    assert [t for p in parts for t in p["t"].to_pylist()] == column
    assert all(sum(len(t or "") // 6 + 1 for t in p["t"].to_pylist()[:-1]) <= lang_id.BLOCK for p in parts)
    assert [p.num_rows for p in lang_id._by_weight(pa.record_batch({"t": pa.array([], pa.string())}), "t")] == [0]
