import re

import duckdb
import pytest

from signalmesh.llm.mixing import ORACLE_SQL, mix, op10_mixing, repeat_rows, targets
from tests.llm.fixtures import SF, SF2, odd_documents


@pytest.mark.parametrize("sf", [SF, SF2])
def test_query_equals_oracle(spark, sf):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    want = sorted(db.execute(ORACLE_SQL).fetchall())
    got = sorted(tuple(r) for r in op10_mixing(spark, sf).select("doc_id", "size", "source_size", "target", "taken").collect())
    assert [g[:3] + g[4:] for g in got] == [w[:3] + w[4:] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], rel=1e-12)


def filled(sizes, weights, share, most):
    """Step by step: share by weight, clamp what is above, share the rest again."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, out = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        full = {s for s in open_ if level * w[s] >= most * sizes[s]}
        for s in full or open_:
            out[s] = most * sizes[s] if full else level * w[s]
        if not full:
            break
        left -= sum(out[s] for s in full)
        open_ -= full
    return out


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 1000, None: 50}, {"a": 5}, {"a": 0, "b": 7, "c": 9, "d": 1000}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    want = filled(sizes, (3.0, 1.0, 2.0), 1.5, 2.0)
    assert {r.source: r.target for r in targets(df).collect()} == pytest.approx(want)


def test_taken_is_near_target_and_repeats(spark, tmp_path):
    rows = [(i, "w " * (1 + i * i % 97), f"s{i % 3}" if i % 7 else None) for i in range(6000)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    got = mix(docs).join(docs.select("doc_id", "source"), "doc_id").collect()
    by = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size)
        by.setdefault(r.source, [r.target, 0])[1] += r.taken
    for target, taken in by.values():
        assert abs(taken - target) <= 0.005 * target
    again = {r.doc_id: r.taken for r in mix(docs).collect()}
    assert again == {r.doc_id: r.taken for r in got}
    mixed = repeat_rows(docs)
    assert mixed.columns == docs.columns
    words = sum(len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in mixed.collect())
    assert words == sum(r.taken for r in got)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = mix(docs).collect()
    assert len(got) == docs.count()
    assert all(r.taken <= 2 * r.size and r.target >= 0 for r in got)
    assert mix(docs.limit(0)).count() == 0
