"""Streaming form of the per-row stages, landed-page readers and source status."""

import json
import os
import tempfile

from pyspark.sql import functions as F

from signalmesh.config import FIXTURE_THEMES
from signalmesh.sources import pages as pg
from signalmesh.streaming import feed_stream as fs
from signalmesh.operators import normalize as nz, themes as th
from signalmesh.sources import fixtures as fx

SF = "/root/testdata/sf0.001"


def test_stream_equals_batch(spark):
    ck = tempfile.mkdtemp(prefix="sm-stream-")
    got = fs.run_to_table(fs.tagged_ticket_stream(fs.document_stream(spark, SF), FIXTURE_THEMES), "sm_stream", ck)
    batch = th.tag_signals(nz.ticket_signals(nz.tickets_clean(fx.tickets(spark, SF))), FIXTURE_THEMES).withColumn(
        "quote", nz.signal_quote())
    a = sorted((r.id, tuple(r.theme_idxs), tuple(r.pii), r.quote) for r in got.collect())
    b = sorted((r.id, tuple(r.theme_idxs), tuple(r.pii), r.quote) for r in batch.collect())
    assert a == b and len(a) > 0


def test_page_readers(spark):
    d = tempfile.mkdtemp(prefix="sm-pages-")
    with open(os.path.join(d, "p1.json"), "w") as f:
        f.write(json.dumps({"_embedded": {"conversations": [{"id": 1, "number": 101, "subject": "Billing question",
                                                             "status": "active", "state": "published", "mailboxId": 10,
                                                             "createdAt": "2026-06-01T00:00:00Z", "closedAt": None,
                                                             "tags": [{"id": 1, "tag": "bug"}],
                                                             "primaryCustomer": {"email": "a@b.com"},
                                                             "preview": "Please check my invoice", "threads": 4}]},
                            "page": {"totalElements": 1, "totalPages": 1, "number": 1, "size": 50}}) + "\n")
        f.write(json.dumps({"page": {"totalElements": 0, "totalPages": 1, "number": 2, "size": 50}}) + "\n")
    rows = pg.read_ticket_pages(spark, d).collect()
    assert len(rows) == 1 and rows[0].subject == "Billing question" and rows[0].customer_email is None
    clean = nz.tickets_clean(pg.read_ticket_pages(spark, d)).first()
    assert list(clean.tags) == ["bug"] and clean.thread_count == 4


def test_source_status(spark):
    def boom():
        raise RuntimeError("portal down, contact ops@example.com")
    st = pg.source_status(spark, {"support_tickets": lambda: fx.tickets(spark, SF), "feature_votes": boom})
    rows = {r.source: r for r in st.collect()}
    assert rows["support_tickets"].ok and not rows["feature_votes"].ok
    assert "[EMAIL REDACTED]" in rows["feature_votes"].warning
    assert not pg.run_failed(st, "support_tickets", ["feature_votes"])
    failed = pg.source_status(spark, {"support_tickets": boom, "a": boom, "b": lambda: fx.posts(spark, SF)})
    assert pg.run_failed(failed, "support_tickets", ["a", "b"], 0)
    assert not pg.run_failed(failed, "support_tickets", ["a", "b"], 3)
    assert not pg.run_failed(failed, "support_tickets", ["b"], 0) and pg.run_failed(failed, "support_tickets", [])


def test_truncated_and_pretty_printed_pages(spark):
    page = {"_embedded": {"conversations": [{"id": 1, "subject": "s"}]}, "page": {"number": 1}}
    lines, files = tempfile.mkdtemp(prefix="sm-pages-"), tempfile.mkdtemp(prefix="sm-pages-")
    with open(os.path.join(lines, "p.json"), "w") as f:
        f.write(json.dumps(page) + "\n" + json.dumps(page)[:-30] + "\n")
    assert pg.read_ticket_pages(spark, lines).filter("id is not null").count() >= 1
    warnings = pg.page_warnings(spark, lines, pg.TICKET_PAGE, "support_tickets").collect()
    assert [r.source for r in warnings] == ["support_tickets"] and "p.json" in warnings[0].warning
    for i, text in enumerate((json.dumps(page, indent=2), json.dumps(page, indent=2)[:-20])):
        with open(os.path.join(files, f"p{i}.json"), "w") as f:
            f.write(text)
    assert pg.read_ticket_pages(spark, files, multi_line=True).filter("id = 1").count() >= 1
    assert len(pg.page_warnings(spark, files, pg.TICKET_PAGE, "t", multi_line=True).collect()) == 1
