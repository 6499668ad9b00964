"""Rows keep their numbers when the cluster, and so the splits of a scan, changes between jobs."""

import itertools

import pytest

from signalmesh.llm import common
from signalmesh.llm.exact_dedup import drop_copies
from signalmesh.llm.mixing import repeat_rows
from signalmesh.llm.near_dedup import drop_near_copies, near_groups
from signalmesh.llm.pii import find_pii
from signalmesh.llm.suffix_dedup import drop_repeated
from tests.llm.fixtures import documents

SPLITS = "spark.sql.files.minPartitionNum"


@pytest.fixture
def docs(spark, tmp_path):
    documents(spark).repartition(12, "doc_id").write.parquet(str(tmp_path / "d"))
    return spark.read.parquet(str(tmp_path / "d"))


def removed(docs):
    lose, keep = drop_repeated(docs)
    return lose.drop("kept").unionByName(keep.select("doc_id", "n_bytes"), allowMissingColumns=True)


@pytest.mark.parametrize("job", [drop_copies, drop_near_copies, repeat_rows, lambda d: near_groups(d).drop(common.RID, "component"),
                                 lambda d: find_pii(d).drop(common.RID), removed],
                         ids=["drop_copies", "drop_near_copies", "repeat_rows", "near_groups", "find_pii", "drop_repeated"])
def test_splits_that_change_between_jobs_change_nothing(spark, docs, monkeypatch, job):
    rows = lambda df: sorted((tuple(r) for r in df.collect()), key=repr)
    before = spark.conf.get(SPLITS, None)
    want = rows(job(docs))
    plain, wanted = common.materialize, itertools.cycle(["9", "2", "12", "1"])

    def changing(df, name):
        out = plain(df, name)
        spark.conf.set(SPLITS, next(wanted))
        return spark.read.parquet(*out.inputFiles()) if out.inputFiles() else out

    monkeypatch.setattr(common, "materialize", changing)
    try:
        spark.conf.set(SPLITS, "9")
        got = rows(job(spark.read.parquet(str(docs.inputFiles()[0].rsplit("/", 1)[0]))))
    finally:
        spark.conf.unset(SPLITS) if before is None else spark.conf.set(SPLITS, before)
    assert got == want and len(want) > 50
