"""Format-layer golden rows: cleaning, privacy drops, quotes, titles, detail levels."""

from pyspark.sql import functions as F

from feeds import feeds, post, ticket
from signalmesh.config import ThemeDef, ThemesConfig
from signalmesh.functions import scoring as sc
from signalmesh.functions import text as tx
from signalmesh.operators import normalize as nz
from signalmesh.operators import quotes as qt
from signalmesh.params import Params
from signalmesh.plans import jobs
from signalmesh.plans.analysis import analyze

CFG = ThemesConfig(2, (ThemeDef("billing", "Billing", ("billing", "invoice"), "billing"),), (), 3)


def test_ticket_clean(spark):
    f = feeds(spark, [ticket(1, "Billing question", preview="mail me at a@b.com or 555-123-4567", threads=4),
                      (2, 2, "Other", "", "active", 1, "2024-01-30T00:00:00", None, [], None, None)])
    rows = {r.id: r for r in nz.tickets_clean(f.tickets).collect()}
    assert rows[1].thread_count == 4 and rows[2].thread_count == 0
    assert rows[1].customer_email == "[REDACTED]"
    assert set(rows[1].pii) == {"email", "phone"}
    assert list(rows[2].customer_messages) == []


def test_request_clean_drops_names(spark):
    raw = spark.createDataFrame(
        [("a", "CSV export", "desc", {"id": 1, "name": "Planned", "color": "x"}, None, 12, 1, "2024-01-01", "2024-01-01",
          "u", "acme", [{"id": "c1", "comment": "please", "author": {"id": "u1", "name": "Jane", "role": "user"},
                         "pinned_to_top": False, "tagged_for_changelog": False, "parent_id": None,
                         "created_at": "2024-01-01", "updated_at": None, "url": "x"}])],
        "id string, title string, description string, status struct<id:int,name:string,color:string>, "
        "category struct<id:int,name:string,color:string>, votes_count bigint, comments_count bigint, "
        "created_at string, updated_at string, url string, portal string, comments array<struct<id:string,"
        "comment:string,author:struct<id:string,name:string,role:string>,pinned_to_top:boolean,"
        "tagged_for_changelog:boolean,parent_id:string,created_at:string,updated_at:string,url:string>>")
    r = nz.requests_clean(raw).first()
    assert r.status == "Planned" and r.portal == "acme"
    assert set(r.comments[0].asDict()) == {"role", "comment", "created_at"}
    assert "Jane" not in str(r.asDict(recursive=True))


def _quote(spark, msg, subject="subj"):
    df = spark.createDataFrame([(msg, subject)], "m string, s string")
    return df.select(tx.ticket_quote(F.col("m"), F.col("s")).alias("q")).first().q


def test_quotes(spark):
    assert _quote(spark, "line one\nline two") == '[Support ticket] "line one line two"'
    assert _quote(spark, "x" * 200) == '[Support ticket] "' + "x" * 200 + '"'
    assert _quote(spark, "x" * 201) == '[Support ticket] "' + "x" * 197 + '..."'
    assert _quote(spark, "Happy to help!", "Refund please") == '[Support ticket] "Refund please"'
    assert _quote(spark, "Happy to help!", "Let me know if ok") is None
    df = spark.createDataFrame([([{"role": "admin", "comment": "ok", "created_at": None},
                                  {"role": "user", "comment": "   ", "created_at": None}], "T", 3)],
                               "c array<struct<role:string,comment:string,created_at:string>>, t string, v bigint")
    assert df.select(tx.request_quote(F.col("c"), F.col("t"), F.col("v")).alias("q")).first().q == \
        '[Feature request, 3 votes] ""'
    df = spark.createDataFrame([([{"role": "admin", "comment": "ok", "created_at": None}], "Title", 2)],
                               "c array<struct<role:string,comment:string,created_at:string>>, t string, v bigint")
    assert df.select(tx.request_quote(F.col("c"), F.col("t"), F.col("v")).alias("q")).first().q == \
        '[Feature request, 2 votes] "Title"'


def test_titles_cap_and_summary(spark):
    a = analyze(feeds(spark, [ticket(i, f"billing issue {i}") for i in range(60)]), CFG, Params())
    tot = qt.title_totals(a.points).first()
    assert tot.data_points_total == 60 and tot.data_point_titles_truncated is True
    assert qt.theme_titles(a.points).count() == 50
    two = analyze(feeds(spark, [ticket(1, "billing a")], [post(1, "billing b")]), CFG, Params())
    v = jobs.themes_view(two, "summary").first()
    assert "2 signals" in v.evidence_summary and "frequency_score" not in v.asDict()
    s = jobs.themes_view(two, "standard").first()
    assert s.data_points_total == 2 and s.data_point_titles_truncated is False


def test_js_number(spark):
    df = spark.createDataFrame([(100.0,), (134.6,), (0.5,)], "x double")
    assert [r.s for r in df.select(sc.js_number(F.col("x")).alias("s")).collect()] == ["100", "134.6", "0.5"]


def test_markdown_shape(spark):
    a = analyze(feeds(spark, [ticket(1, "billing a", preview="the invoice is wrong")],
                      [post(1, "billing b", votes=3)]), CFG, Params())
    text = jobs.plan_markdown_text(a, Params(fmt="markdown", kpi_context="churn 3%")).first().markdown
    assert text.startswith("# Product Plan — 30-day window\n")
    assert "## Priorities" in text and "| 1 | Billing |" in text and "## Business context (KPI)" in text
    assert text.endswith("churn 3%\n") and not text.endswith("\n\n")


def test_quote_probe_fallback(spark):
    # the first ten tickets (newest first) are agent text on both fields, so the
    # probe finds nothing and the theme falls back to all of its points
    from feeds import days_ago
    agent = [ticket(i, "Let me know if billing works", preview="Happy to help with billing", created=days_ago(0.01 * i))
             for i in range(1, 11)]
    real = [ticket(20 + i, f"billing broken {i}", preview=f"my invoice {i} is wrong", created=days_ago(1 + i))
            for i in range(4)]
    a = analyze(feeds(spark, agent + real), CFG, Params())
    got = [r.quote for r in a.quotes().orderBy("quote_rank").collect()]
    assert got == [f'[Support ticket] "my invoice {i} is wrong"' for i in range(3)]


def test_plan_document_and_config(spark, tmp_path):
    import json as _json
    from signalmesh.config import load_themes_config, read_themes_config, DEFAULT_THEMES
    a = analyze(feeds(spark, [ticket(1, "billing a", preview="the invoice is wrong")],
                      [post(1, "billing b", votes=3)]), CFG, Params())
    doc = _json.loads(jobs.plan_document(a, Params(kpi_context="churn 3%")).first().plan_json)
    assert doc["kpi_context"] == {"provided": True, "note": jobs.KPI_NOTE_GIVEN, "metrics": "churn 3%"}
    assert doc["priorities"][0]["rank"] == 1 and doc["summary"]["total_signals_analyzed"] == 2
    none = _json.loads(jobs.plan_document(a, Params()).first().plan_json)["kpi_context"]
    assert none == {"provided": False, "note": jobs.KPI_NOTE_NONE}
    path = tmp_path / "themes.json"
    path.write_text(_json.dumps(DEFAULT_THEMES.to_dict()))
    assert load_themes_config(path) == DEFAULT_THEMES
    assert read_themes_config(spark, str(path)) == DEFAULT_THEMES
    bad = tmp_path / "bad.json"
    bad.write_text('{"themes": {}}')
    import pytest as _pytest
    with _pytest.raises(ValueError):
        load_themes_config(bad)


def test_quotes_collapse_a_message_once(spark):
    from signalmesh.operators import quotes as qt

    rows = [("REACTIVE", "t", b, d, None, 0) for b in ("a \t b", "  x  ", " ", "", None, "a b  c d", "happy\n\nto  help", "y" * 300) for d in (True, False)]
    rows += [("PROACTIVE", "t", "b", False, c, 3) for c in (None, " c\n d ", "glad  to")]
    df = spark.createDataFrame(rows, "source string, title string, body string, msg_dup boolean, first_comment string, votes bigint")
    out = qt.with_quote(df)
    plain = df.withColumn("quote", nz.signal_quote())
    named = lambda d: d._jdf.queryExecution().optimizedPlan().toString().count("]{2,}|[")
    assert named(out) == 4 < named(plain)  # the message once, and a comment's text in three places of its cut
    assert out.columns == plain.columns and out.collect() == plain.collect()
    assert {r.quote for r in out.collect()} >= {'[Support ticket] "a b"', '[Support ticket] "a b c d"', '[Feature request, 3 votes] "c d"'}
