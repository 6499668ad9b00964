"""Distributed greedy claiming (A9) equals the sequential walk."""

import random

from pyspark.sql import functions as F

from seq_emerging import sequential_emerging
from signalmesh.config import ThemesConfig
from signalmesh.operators.emerging import emerging_themes

WORDS = ["alpha", "bravo", "charlie", "delta", "echo", "foxtrot", "golf", "hotel"]


def _frame(spark, texts):
    rows = [(f"p{i}", "REACTIVE", f"t{i}", t, (0, "", 0, i, i)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "id string, source string, title string, text string, "
                                       "ord struct<src:int,portal:string,grp:int,k1:bigint,k2:bigint>")


def _distributed(spark, texts, minf):
    cfg = ThemesConfig(1, (), ("the",), minf)
    em, pts = emerging_themes(_frame(spark, texts), cfg)
    order = [r.ngram for r in em.orderBy("rk").collect()]
    freq = {r.ngram: r.frequency for r in em.collect()}
    members = {}
    for r in pts.orderBy("ord").collect():
        members.setdefault(r.ngram, []).append(r.id)
    return [(g, freq[g], members[g]) for g in order]


def test_random_instances(spark):
    rnd = random.Random(7)
    for trial in range(6):
        texts = [" ".join(rnd.choice(WORDS[: 4 + trial % 4]) for _ in range(rnd.randint(1, 9))) for _ in range(40)]
        pts = [{"id": f"p{i}", "text": t} for i, t in enumerate(texts)]
        for minf in (2, 3):
            assert _distributed(spark, texts, minf) == sequential_emerging(pts, ("the",), minf), (trial, minf)


def test_claiming_drops_later_ngram(spark):
    texts = ["red blue green", "red blue green", "red blue", "blue green", "blue green"]
    pts = [{"id": f"p{i}", "text": t} for i, t in enumerate(texts)]
    assert _distributed(spark, texts, 2) == sequential_emerging(pts, (), 2)


def test_fixture_tables_equal_sequential_walk(spark):
    """A9 over the real unmatched signals of the sf0.01 tables vs brute force."""
    from signalmesh.config import FIXTURE_THEMES
    from signalmesh.operators.normalize import with_text
    from signalmesh.params import Params
    from signalmesh.plans.analysis import analyze, fixture_feeds

    a = analyze(fixture_feeds(spark, "/root/testdata/sf0.01"), FIXTURE_THEMES, Params())
    pts = [{"id": r.id, "text": r.text} for r in with_text(a.unmatched).orderBy("ord").select("id", "text").collect()]
    want = sequential_emerging(pts, FIXTURE_THEMES.stop_words, FIXTURE_THEMES.emerging_theme_min_frequency)
    order = [r.ngram for r in a.emerging.orderBy("rk").collect()]
    freq = {r.ngram: r.frequency for r in a.emerging.collect()}
    members = {}
    for r in a.emerging_points.orderBy("ord").collect():
        members.setdefault(r.ngram, []).append(r.id)
    assert [(g, freq[g], members[g]) for g in order] == want and len(want) > 0


def test_repeated_rows_and_edited_tickets_keep_their_members(spark):
    cfg = ThemesConfig(1, (), (), 3)
    same = (0, "", 0, 1, 1)
    rows = [("p1", "REACTIVE", "t", "red blue", same), ("p1", "REACTIVE", "t", "red blue", same),
            ("p1", "REACTIVE", "t", "green grey", same), ("p2", "REACTIVE", "u", "red blue", (0, "", 0, 2, 2))]
    em, pts = emerging_themes(spark.createDataFrame(rows, _frame(spark, ["x"]).schema), cfg)
    assert [(r.ngram, r.frequency) for r in em.collect()] == [("red blue", 3)]
    assert sorted((r.ngram, r.id) for r in pts.collect()) == [("red blue", "p1"), ("red blue", "p1"), ("red blue", "p2")]
    assert pts.schema["ord"].dataType == _frame(spark, ["x"]).schema["ord"].dataType
