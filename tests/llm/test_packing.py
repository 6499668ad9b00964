import array
import zlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmesh.llm.packing import CAPACITY, WordIds, cuts, harmonic_pack, op1_harmonic_packing
from tests.llm.fixtures import ODD_TEXTS, SF, documents, odd_documents


@pytest.fixture(scope="module")
def tokenizer():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def whole(tokenizer, text):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_word_cache_equals_tokenizer(tokenizer):
    import public_tokenizers

    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"), cached=50)
    for text in ODD_TEXTS + [" ".join(ODD_TEXTS)] + ["don't we're 's", "İx ſy ŒUVRE.", "<|endoftext|> a<|startoftext|>b", "\x1cfoo a_b", "日本 x² é"]:
        assert ids.text(text) == array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes()


def test_control_characters_after_letters(tokenizer):
    import public_tokenizers

    ids = WordIds(public_tokenizers.path("word_bpe_49k.json"))
    for c in [*map(chr, range(0x300)), "\u2028", "\ufeff"]:
        for text in (f"a{c}", f"{c}a", f"a{c}b", f"ab.{c}", f"é{c}", c):
            assert ids.text(text) == array.array("I", tokenizer.encode(text, add_special_tokens=False).ids).tobytes(), repr(text)


def test_cuts():
    for n in range(1, 3 * CAPACITY):
        pieces = list(cuts(n))
        assert sum(pieces) == n and min(pieces) > 0 and max(pieces) <= CAPACITY
        assert len(pieces) <= n // CAPACITY + 8


def check(rows, texts, tokenizer):
    """Every id once, sequences gapless, little padding except at powers of two."""
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for doc_id, text in texts.items():
        ids, at = whole(tokenizer, text), 0
        for r in sorted(by_doc[doc_id], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(array.array("I", ids[at: at + r.length]).tobytes())
            at += r.length
        assert at == len(ids)
    used = padded = 0
    for rs in by_sequence.values():
        at = 0
        for r in sorted(rs, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= CAPACITY
        used += at
        padded += 0 if at & (at - 1) == 0 else CAPACITY - at
    assert padded <= 0.01 * (used + padded)


def test_query(spark, tokenizer):
    rows = op1_harmonic_packing(spark, SF).collect()
    check(rows, dict(documents(spark).select("doc_id", "text").collect()), tokenizer)


def test_odd_rows(spark, tokenizer):
    docs = odd_documents(spark)
    rows = harmonic_pack(docs.filter("doc_id is not null").dropDuplicates(["doc_id"])).withColumn("ids_crc32", F.crc32("ids")).collect()
    check(rows, dict(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()), tokenizer)
    assert harmonic_pack(docs).count() >= docs.count()
    assert harmonic_pack(docs.limit(0)).count() == 0
    long = spark.createDataFrame([(1, "word " * 300_000)], "doc_id long, text string")
    assert harmonic_pack(long).agg(F.sum("length")).first()[0] == 300_001


def test_other_names(spark):
    df = spark.createDataFrame([(1, "a b", 2)], T.StructType([T.StructField(n, t) for n, t in (("id", T.LongType()), ("body", T.StringType()), ("offset", T.LongType()))]))
    assert harmonic_pack(df, "id", "body").agg(F.sum("length")).first()[0] == 3
