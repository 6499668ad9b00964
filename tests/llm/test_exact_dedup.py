import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from signalmesh.llm.exact_dedup import drop_copies, exact_groups, op9_exact_dedup
from tests.llm.fixtures import SF, documents, odd_documents


def brute(rows):
    groups = defaultdict(list)
    norm = lambda t: (t or "").encode().lower()
    for doc_id, text in rows:
        groups[norm(text)].append(doc_id)
    out = []
    for doc_id, text in rows:
        ids = groups[norm(text)]
        keep = max((i for i in ids if i is not None), default=None)
        out.append((doc_id, keep, len(ids), doc_id == keep, hashlib.sha256(norm(text)).hexdigest()))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect()), key=repr)


def test_query(spark):
    assert got(op9_exact_dedup(spark, SF)) == brute([tuple(r) for r in documents(spark).select("doc_id", "text").collect()])


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert got(exact_groups(docs)) == brute(rows)
    assert exact_groups(docs.limit(0)).count() == 0
    assert got(exact_groups(docs, salts=1)) == brute(rows)


def test_equal_digests_are_told_apart_by_text(spark):
    docs = odd_documents(spark)
    short = F.substring("sha", 1, 0)  # all texts share it
    assert got(exact_groups(docs, digest=short)) == got(exact_groups(docs))
    one_bit = F.expr("cast(conv(hex(substring(sha, 1, 1)), 16, 10) % 2 as int)")
    assert got(exact_groups(docs, digest=one_bit)) == got(exact_groups(docs))


def test_drop_copies_leaves_one_row_a_text(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    kept = drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [(r.text or "").encode().lower() for r in kept.collect()]
    assert len(texts) == len(set(texts))
    assert set(texts) == {(r.text or "").encode().lower() for r in docs.collect()}
