"""Written tables: what is read back, and what is deleted again."""

import os

import pytest

from signalmesh.plans import queries as q
from signalmesh.llm.exact_dedup import drop_copies
from signalmesh.llm.near_dedup import drop_near_copies
from signalmesh.session import discard, ensure_checkpoint_dir, materialize, only_result


def tables(spark):
    folder = ensure_checkpoint_dir(spark).removeprefix("file:") + "/tables"
    return set(os.listdir(folder)) if os.path.isdir(folder) else set()


def test_discard_deletes_written_tables_only(spark, tmp_path):
    kept = str(tmp_path / "kept")
    spark.range(5).write.parquet(kept)
    before = tables(spark)
    one, other = materialize(spark.range(3), "one"), materialize(spark.range(4), "other")
    assert len(tables(spark) - before) == 2
    discard(one.join(spark.read.parquet(kept), "id"))
    assert len(tables(spark) - before) == 1 and other.count() == 4 and spark.read.parquet(kept).count() == 5
    with pytest.raises(Exception):
        one.count()
    discard(other)
    assert tables(spark) == before


def test_changed_tables_are_seen(spark, tmp_path):
    sf = str(tmp_path)
    write = lambda n: spark.range(n).write.mode("overwrite").parquet(f"{sf}/documents.parquet")
    write(3)
    first = q.files_state(spark, sf, "documents")
    assert q.files_state(spark, sf, "documents") == first
    write(4)
    assert q.files_state(spark, sf, "documents") != first


def test_only_the_result_of_a_build_stays(spark):
    before = tables(spark)
    build = lambda: only_result(spark, lambda: materialize(spark.range(3), "inner"), "inner-result").join(materialize(spark.range(2), "way"), "id")
    out = only_result(spark, build, "result")
    assert [t.split("-")[0] for t in tables(spark) - before] == ["result"] and out.count() == 2
    outside = materialize(spark.range(1), "outside")
    with pytest.raises(ZeroDivisionError):
        only_result(spark, lambda: 1 / 0, "none")
    assert outside.count() == 1 and len(tables(spark) - before) == 2


@pytest.mark.parametrize("drop, n", [(drop_copies, 2), (drop_near_copies, 2)])
def test_a_stage_leaves_its_rows_and_what_it_keeps_of_them(spark, drop, n):
    text = "one two three four five six seven eight nine ten"
    docs = materialize(spark.createDataFrame([(1, text), (2, text), (3, text + " x"), (4, "other words of another text here"), (5, None)], "doc_id long, text string"), "docs")
    before = tables(spark)
    out = drop(docs)
    made = tables(spark) - before
    assert len(made) == n and {t.split("-")[0] for t in made} == {"numbered", drop is drop_copies and "exact" or "near"}
    assert sorted(r.doc_id for r in out.collect()) == ([2, 3, 4, 5] if drop is drop_copies else [1, 4, 5])
