"""Matching, scoring and emerging-theme golden rows (the reference's analyzer
suite), run through the Spark operators."""

import math

import pytest
from pyspark.sql import functions as F

from feeds import days_ago, feeds, post, ticket
from signalmesh.config import ThemeDef, ThemesConfig
from signalmesh.functions import text as tx
from signalmesh.params import Params
from signalmesh.plans.analysis import analyze

CFG = ThemesConfig(
    version=2,
    themes=(ThemeDef("billing", "Billing", ("billing", "invoice"), "billing"),
            ThemeDef("api", "API", ("api",), "integration"),
            ThemeDef("booking", "Booking", ("time slot",), "core")),
    stop_words=("the", "a", "to", "and", "is", "we", "need", "with"),
    emerging_theme_min_frequency=2,
)


@pytest.mark.parametrize("text,kws,want", [
    ("i want a custom time slot please", ["time slot"], True),
    ("the api broke today", ["api"], True),
    ("we need rapid responses", ["api"], False),
    ("billing is wrong", ["billing"], True),
    ("everything is fine", ["billing", "api"], False),
    ("double option", ["double opt"], True),
    ("éapi works", ["api"], True),
    ("api-key", ["api"], True),
    ("rapi", ["api"], False),
])
def test_keyword_match(spark, text, kws, want):
    df = spark.createDataFrame([(text.lower(),)], "t string")
    assert df.select(tx.keyword_match(F.col("t"), kws).alias("m")).first().m is want


def run(spark, tickets=(), posts=(), cfg=CFG):
    return analyze(feeds(spark, tickets, posts), cfg, Params())


def scores(a):
    return {r.theme_id: r for r in a.scores.collect()}


def test_empty_inputs(spark):
    a = run(spark)
    s = a.summary().first()
    assert s.total_data_points == 0 and s.unmatched_count == 0 and s.known_themes_count == 3
    assert a.scores.count() == 0
    assert a.emerging.count() == 0


def test_convergent_boost(spark):
    a = run(spark, [ticket(1, "billing issue with my invoice")], [post(1, "billing export", votes=10)])
    b = scores(a)["billing"]
    assert b.convergent and b.reactive_count == 1 and b.proactive_count == 1
    base = b.frequency_score * 0.35 + b.severity_score * 0.35 + b.vote_momentum_score * 0.3
    assert b.priority_score == pytest.approx(math.floor(base * 2 * 100 + 0.5) / 100, abs=0.1)


def test_proactive_only(spark):
    a = run(spark, [], [post(1, "api access please", votes=5)])
    r = scores(a)["api"]
    assert not r.convergent and r.reactive_count == 0 and r.proactive_count == 1
    assert r.severity_score == 0 and r.vote_momentum_score > 0


def test_thread_baseline(spark):
    a = run(spark, [ticket(1, "billing a", threads=0), ticket(2, "api b", threads=1)])
    s = scores(a)
    assert s["billing"].severity_score == s["api"].severity_score
    a = run(spark, [ticket(1, "billing a", threads=3), ticket(2, "api b", threads=1)])
    s = scores(a)
    assert s["billing"].severity_score > s["api"].severity_score


def test_severity_cap(spark):
    a = run(spark, [ticket(1, "billing", threads=100, tags=["critical"])])
    assert scores(a)["billing"].severity_score <= 100


def test_bad_and_future_dates(spark):
    # windowing happens on the feed; analyze the signal scores directly
    from signalmesh.operators import normalize as nz, themes as th
    from signalmesh.config import themes_frame
    f = feeds(spark, [ticket(1, "billing x", created="not-a-date"), ticket(2, "api y", created=days_ago(-30)),
                      ticket(3, "time slot z")])
    sig = th.tag_signals(nz.ticket_signals(nz.tickets_clean(f.tickets)), CFG)
    sc = {r.theme_id: r for r in th.theme_scores(th.theme_points(sig), themes_frame(spark, CFG), Params()).collect()}
    assert math.isfinite(sc["billing"].severity_score)
    assert sc["api"].severity_score <= sc["booking"].severity_score + 1e-9


def test_tag_boost_first_match(spark):
    from signalmesh.functions.scoring import tag_boost
    df = spark.createDataFrame([(["Bug", "urgent"],), (["vip", "Escalation"],), ([],), (["constructor"],)],
                               "t array<string>")
    assert [r.b for r in df.select(tag_boost(F.col("t")).alias("b")).collect()] == [20.0, 30.0, 0.0, 0.0]


def test_unmatched(spark):
    a = run(spark, [ticket(1, "something totally unrelated zxqw")])
    assert a.summary().first().unmatched_count == 1


def test_emerging_dark_mode(spark):
    a = run(spark, [ticket(1, "dark mode missing everywhere"), ticket(2, "please add dark mode option"),
                    ticket(3, "dark mode would be great")])
    assert a.summary().first().unmatched_count == 3
    rows = a.emerging.collect()
    assert any("dark mode" in r.ngram and r.frequency >= 2 for r in rows)


def test_placeholders_never_ngrams(spark):
    a = run(spark, [ticket(i, "contact form", preview=f"reach me at a{i}@b.com or 555-123-456{i} please")
                    for i in range(1, 4)])
    assert all("redacted" not in r.ngram for r in a.emerging.collect())


def test_unmatched_by_id(spark):
    # the same post id in two portals: one matches, so both leave the unmatched set
    a = run(spark, [], [post(7, "billing please", portal="a"), post(7, "nothing here", portal="b")])
    assert a.summary().first().unmatched_count == 0
