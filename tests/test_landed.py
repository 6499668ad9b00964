"""Landed feeds: failure isolation, warnings from the reading pass, comment payloads, portal order."""

import json

import pytest

from signalmesh.config import ThemeDef, ThemesConfig
from signalmesh.params import Params
from signalmesh.plans import analysis as an
from signalmesh.plans import jobs
from signalmesh.sources import landed as ld

CFG = ThemesConfig(2, (ThemeDef("billing", "Billing", ("billing",), "b"),), (), 3)
DATE = "2024-01-30T00:00:00Z"


def write(folder, *records):
    folder.mkdir(parents=True)
    (folder / "p.json").write_text("".join(r + "\n" for r in records))
    return str(folder)


def tickets(*ids):
    return json.dumps({"_embedded": {"conversations": [
        {"id": i, "number": i, "subject": f"billing {i}", "status": "active", "mailboxId": 1, "createdAt": DATE, "tags": [{"id": 1, "tag": "bug"}],
         "primaryCustomer": {"email": "a@b.com"}, "preview": "", "threads": 2} for i in ids]}, "page": {"number": 1}})


def posts(*items):
    return json.dumps({"data": [{"id": i, "title": t, "description": "", "status": {"id": 1, "name": "Open", "color": ""}, "votes_count": v,
                                 "comments_count": 0, "created_at": DATE, "updated_at": DATE} for i, t, v in items],
                       "hasMore": False, "total": len(items), "skip": 0, "limit": 10})


@pytest.fixture
def folders(tmp_path):
    mailboxes = json.dumps({"_embedded": {"mailboxes": [{"id": 1, "name": "Support"}]}})
    return {"tickets": write(tmp_path / "t", tickets(1, 2), tickets(3)), "mailboxes": write(tmp_path / "m", mailboxes),
            "z": write(tmp_path / "z", posts(("1", "billing z", 3))), "a": write(tmp_path / "a", posts(("1", "billing a", 3))),
            "torn": write(tmp_path / "torn", posts(("9", "billing torn", 1)), posts(("10", "gone", 1))[:-40]),
            "none": str(tmp_path / "ops@example.com" / "none")}


def read(spark, f, *portals, tickets="tickets", **kw):
    return ld.read_landed(spark, f[tickets], f["mailboxes"], [(p, f"https://{p}", f[p]) for p in portals], **kw)


def test_a_torn_page_gives_the_other_rows_and_one_warning(spark, folders):
    run = read(spark, folders, "z", "torn")
    assert sorted(r.id for r in run.posts.collect()) == ["1", "9"] and run.tickets.count() == 3
    status = {r.source: r for r in run.status.collect()}
    assert status["torn"].ok and (status["torn"].pages, status["torn"].unreadable_pages) == (2, 1)
    assert "1 of 2 pages" in status["torn"].warning
    assert [s for s, r in status.items() if r.warning] == ["torn"] and status["support_tickets"].pages == 2


def test_rows_are_read_from_the_written_table_not_again(spark, folders):
    run = read(spark, folders, "z")
    plan = run.posts._jdf.queryExecution().executedPlan().toString()
    assert "json" not in plan.lower() and "parquet" in plan.lower()


def test_a_failed_portal_is_a_scrubbed_warning(spark, folders):
    run = read(spark, folders, "none", "z")
    status = {r.source: r for r in run.status.collect()}
    assert not status["none"].ok and status["none"].warning.startswith("none fetch failed")
    assert "ops@example.com" not in status["none"].warning
    assert [r.portal for r in run.posts.collect()] == ["z"]


def test_total_failure_raises_with_all_warnings(spark, folders):
    with pytest.raises(ValueError, match="support_tickets fetch failed"):
        read(spark, folders, tickets="none")
    with pytest.raises(ValueError, match="none fetch failed") as caught:
        read(spark, folders, "none", tickets="none")
    assert "ops@example.com" not in str(caught.value)
    run = read(spark, folders, "none", "z", tickets="none")  # requests are left
    assert run.tickets.count() == 0 and an.analyze(an.landed_feeds(run), CFG, Params()).scores.first().proactive_count == 1
    assert read(spark, folders, "none").tickets.count() == 3


def test_portals_keep_their_configured_order(spark, folders):
    def titles(*portals):
        a = an.analyze(an.landed_feeds(read(spark, folders, *portals)), CFG, Params())
        return [r.title for r in a.titles().orderBy("title_rank").collect()][-2:], [r.quote for r in a.quotes().orderBy("quote_rank").collect()]

    assert titles("z", "a")[0] == ["billing z", "billing a"] and titles("a", "z")[0] == ["billing a", "billing z"]


def test_a_run_on_landed_pages(spark, folders):
    a = an.analyze(an.landed_feeds(read(spark, folders, "z", "a")), CFG, Params())
    row = jobs.themes_view(a, "summary").first()
    assert (row.theme_id, row.reactive_count, row.proactive_count, row.convergent) == ("billing", 3, 2, True)


def test_comment_payloads_of_any_form(spark):
    one = {"id": 7, "comment": "only", "author": {"id": 1, "name": "A Name", "role": "admin"}, "created_at": DATE}
    two = {"id": 8, "comment": None, "author": None}
    payloads = [("object", json.dumps({"data": one})), ("array", json.dumps({"data": [one, two]})), ("empty", json.dumps({"data": []})),
                ("null", json.dumps({"data": None})), ("missing", "{}"), ("torn", json.dumps({"data": [one]})[:-3]), ("text", json.dumps({"data": "x"})),
                ("none", None), ("page", json.dumps({"data": [one], "hasMore": False, "total": 1}))]
    df = spark.createDataFrame([("p", *x) for x in payloads], "portal string, post_id string, payload string")
    rows = ld.comment_rows(df)
    assert "name" not in " ".join(rows.columns)
    got = sorted((r.post_id, r.pos, r.role, r.comment) for r in rows.collect())
    assert got == [("array", 0, "admin", "only"), ("array", 1, None, None), ("object", 0, "admin", "only"), ("page", 0, "admin", "only")]


def test_landed_comments_carry_their_portal(spark, folders, tmp_path):
    path = write(tmp_path / "c", json.dumps({"post_id": "1", "payload": json.dumps({"data": {"comment": "hi", "author": {"role": "user"}}})}))
    run = read(spark, folders, "z", "a", comments={"z": path})
    assert [(r.portal, r.post_id, r.comment) for r in run.comments.collect()] == [("z", "1", "hi")]
