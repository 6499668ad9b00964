"""Each stage against a brute-force version on its own input."""

import corpus_pipeline
from signalmesh.llm.common import written
from tests.llm.fixtures import SF, documents
from tests.llm.test_near_dedup import brute as near_brute


def test_stages(spark):
    docs = documents(spark)
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "exact_dedup", "near_dedup", "mixing", "packing"]

    def run(name, df):
        out = written(stages[name](spark, df, SF), name)
        assert name == "packing" or out.columns == docs.columns
        return out

    told = run("language_id", docs)
    assert {r.doc_id for r in told.collect()} == {r.doc_id for r in docs.collect() if any(map(str.isalpha, r.text or ""))}
    exact = run("exact_dedup", told)
    last = {}
    for r in told.collect():
        key = (r.text or "").encode().lower()
        last[key] = max(last.get(key, -1), r.doc_id)
    assert sorted(r.doc_id for r in exact.collect()) == sorted(last.values())
    near = run("near_dedup", exact)
    want = near_brute([(r.doc_id, r.text) for r in exact.collect()])
    assert sorted(r.doc_id for r in near.collect()) == sorted(d for d, _, _, kept in want if kept)
    mixed = run("mixing", near)
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in near.collect()}
    packed = run("packing", mixed)
    assert packed.agg({"length": "sum"}).first()[0] == mixed.join(
        packed.groupBy("doc_id").agg({"doc_tokens": "max"}).toDF("doc_id", "n"), "doc_id").agg({"n": "sum"}).first()[0]
