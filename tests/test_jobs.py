"""Whole jobs as rows, the audit by field and the full listing."""

import pytest
from pyspark.sql import functions as F

from feeds import days_ago, feeds, post, ticket
from signalmesh.config import ThemeDef, ThemesConfig
from signalmesh.operators import themes as th
from signalmesh.params import Params
from signalmesh.plans import jobs
from signalmesh.plans.analysis import analyze

CFG = ThemesConfig(2, (ThemeDef("billing", "Billing", ("billing",), "money"), ThemeDef("api", "API", ("api",), "integration")), ("the",), 2)


@pytest.fixture(scope="module")
def run(spark):
    tickets = [ticket(1, "billing of a@b.com", "call 555-123-4567, billing is wrong"), ticket(2, "dark mode please"), ticket(3, "dark mode now")]
    return analyze(feeds(spark, tickets, [post(1, "billing export", "from c@d.org", votes=10)]), CFG, Params())


def sections(df):
    out = {}
    for r in df.orderBy("section", "place").collect():
        out.setdefault(r.section, []).append((r.place, r.name, r.value))
    return out


def test_synthesis_has_every_section(run, spark):
    status = spark.createDataFrame([("a", True, 1, 0, None), ("b", False, 0, 0, "b fetch failed: gone")],
                                   "source string, ok boolean, pages bigint, unreadable_pages bigint, warning string")
    got = sections(jobs.synthesis_rows(run, Params(), "standard", status))
    assert [n for _, n, _ in got["data_sources"]] == ["feature_votes", "support_tickets"]
    assert [n for _, n, _ in got["pii_categories_redacted"]] == ["email", "phone"]
    assert got["themes"][0][1] == "billing" and "2 signals" in got["themes"][0][2]
    assert [(p, n) for p, n, _ in got["quotes"]] == [(11, "billing"), (12, "billing")]
    assert got["emerging_themes"] == [(1, "dark mode", "2")] and len(got["emerging_samples"]) == 2
    assert dict((n, v) for _, n, v in got["summary"])["total_data_points"] == "4"
    assert got["warnings"] == [(1, "b", "b fetch failed: gone")]
    summary = sections(jobs.synthesis_rows(run, Params(), "summary"))
    assert "warnings" not in summary and "emerging_samples" not in summary


def test_plan_keeps_the_first_priorities_and_the_context(run):
    got = sections(jobs.plan_rows(run, Params(kpi_context="mail x@y.com", max_priorities=1)))
    assert len(got["themes"]) == 1 and got["kpi_context"][2] == (3, "metrics", "mail x@y.com")  # carried as it is
    none = sections(jobs.plan_rows(run, Params()))
    assert [n for _, n, _ in none["kpi_context"]] == ["provided", "note"] and none["metadata"][1][1] == "methodology_version"


def test_audit_names_fields(run):
    rows = {(r.source, r.field, r.handling, r.category): r.signals for r in jobs.pii_audit_fields(run).collect()}
    assert rows["support_tickets", "subject", "redacted", "email"] == 1 and rows["support_tickets", "preview", "redacted", "phone"] == 1
    assert rows["feature_votes", "description", "redacted", "email"] == 1
    assert ("support_tickets", "customer_email", "withheld", None) in rows and ("feature_votes", "title", "sent", None) in rows
    assert not any(h == "sent" and f in ("customer_email", "comments") for _, f, h, _ in rows)


def test_listing_counts_comments_and_their_categories(spark):
    f = feeds(spark, [], [post(1, "x", portal="a"), post(1, "y", portal="b"), post(2, "closed", portal="a", status="done")])
    comments = spark.createDataFrame([("a", 1, 1, "user", "mail a@b.com", None), ("a", 1, 2, "admin", "or 555-123-4567", None),
                                      ("a", 2, 1, "user", "c@d.org", None)],
                                     "portal string, post_id bigint, pos bigint, role string, comment string, created_at string")
    rows = {(r.portal, r.id): r for r in jobs.request_listing(f.posts, comments, Params(status="OPEN")).collect()}
    assert set(rows) == {("a", 1), ("b", 1)}
    assert rows["a", 1].n_comments == 2 and list(rows["a", 1].pii) == ["email", "phone"]
    assert rows["b", 1].n_comments == 0 and list(rows["b", 1].pii) == []
    alone = jobs.request_listing(f.posts, comments, Params(status="open", include_comments=False))
    assert [r.n_comments for r in alone.collect()] == [0, 0] and "comment" not in alone.columns


def test_severity_sums_are_the_same_bits_in_any_partitioning(spark):
    tickets = [ticket(i, "billing", threads=i % 9, created=days_ago(i * 0.0371), tags=["bug"] if i % 3 else []) for i in range(700)]
    signals = analyze(feeds(spark, tickets, []), CFG, Params()).signals
    sums = {th.theme_aggregates(th.theme_points(signals.repartition(n, F.rand(n))), Params()).first().sev_sum.hex() for n in (1, 7, 64)}
    assert len(sums) == 1
