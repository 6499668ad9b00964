"""In-memory raw feeds with the fixture schemas, for golden-row tests."""

from __future__ import annotations

from datetime import datetime, timedelta

from signalmesh.params import FIXTURE_AS_OF
from signalmesh.plans.analysis import Feeds

TICKET_SCHEMA = ("id bigint, number bigint, subject string, preview string, status string, mailbox_id bigint, "
                 "created_at string, closed_at string, tags array<string>, threads int, customer_email string")
POST_SCHEMA = ("id bigint, title string, description string, portal string, status string, category string, "
               "votes_count bigint, comments_count bigint, created_at string, updated_at string, url string, "
               "feed_seq bigint")
NOW = FIXTURE_AS_OF.strftime("%Y-%m-%dT%H:%M:%S")


def ticket(i, subject, preview="", tags=(), threads=1, created=NOW, mailbox=1):
    return (i, i, subject, preview, "active", mailbox, created, None, list(tags), threads, "x@y.com")


def post(i, title, description="", votes=0, comments=0, portal="test", created=NOW, status="open"):
    return (i, title, description, portal, status, None, votes, comments, created, created, None, i)


def feeds(spark, tickets=(), posts=()):
    t = spark.createDataFrame(list(tickets), TICKET_SCHEMA)
    p = spark.createDataFrame(list(posts), POST_SCHEMA)
    mb = spark.createDataFrame([(1, "Support", 0)], "id bigint, name string, pos bigint")
    return Feeds(t, p, mb)


def days_ago(n: float) -> str:
    return (FIXTURE_AS_OF - timedelta(days=n)).strftime("%Y-%m-%dT%H:%M:%S")
