"""Feed selection edge cases (W2/W3) the reference's suite leaves open."""

import pytest

from feeds import days_ago, feeds, post, ticket
from signalmesh.operators import selection as sel
from signalmesh.params import Params


def test_top_voted_ties_and_recent_overlap(spark):
    # portal "a": ids 1..4 old; 2 and 3 tie on votes at the N=2 edge -> feed order keeps 2
    # id 5 is recent and also the most voted -> listed once, as recent (group 0)
    rows = [post(1, "t1", votes=9, portal="a", created=days_ago(60)),
            post(2, "t2", votes=5, portal="a", created=days_ago(60)),
            post(3, "t3", votes=5, portal="a", created=days_ago(60)),
            post(4, "t4", votes=1, portal="a", created=days_ago(60)),
            post(5, "t5", votes=50, portal="a", created=days_ago(1))]
    f = feeds(spark, [], rows)
    got = {(r.id, r.grp) for r in sel.selected_posts(f.posts, Params(top_voted_limit=3)).collect()}
    assert got == {(5, 0), (1, 1), (2, 1)}
    top = [r.id for r in sel.top_voted_posts(f.posts, Params(top_voted_limit=3)).orderBy("vote_rank").collect()]
    assert top == [5, 1, 2]


def test_portal_filter_case_insensitive(spark):
    f = feeds(spark, [], [post(1, "x", portal="Acme"), post(2, "y", portal="other")])
    assert [r.id for r in sel.filter_portal(f.posts, Params(portal_name="acme")).collect()] == [1]
    assert sel.filter_portal(f.posts, Params(portal_name="")).count() == 2


def test_status_filter_skips_null(spark):
    f = feeds(spark, [], [post(1, "x", status="Planned"), post(2, "y", status=None), post(3, "z", status="Open")])
    assert [r.id for r in sel.filter_status(f.posts, Params(status="planned")).collect()] == [1]


def test_string_dates_with_offsets_and_unreadable_ones(spark):
    created = {1: "2024-01-31T01:00:00+02:00", 2: "not a date", 3: "2024-01-31T01:00:00", 4: "2024-01-30T12:00:00Z", 5: None}
    f = feeds(spark, [ticket(i, "s", created=c) for i, c in created.items()], [post(i, "p", created=c) for i, c in created.items()])
    assert sorted(r.id for r in sel.tickets_in_window(f.tickets, Params()).collect()) == [1, 4]
    assert sorted(r.id for r in sel.recent_posts(f.posts, Params()).collect()) == [1, 3, 4]


def test_unknown_names_raise_and_list_what_there_is(spark):
    f = feeds(spark, [ticket(1, "s")], [])
    with pytest.raises(ValueError, match="Support"):
        sel.filter_mailbox(f.tickets, f.mailboxes, Params(mailbox_name="nobody"))
    assert sel.filter_mailbox(f.tickets, f.mailboxes, Params(mailbox_name="support")).count() == 1
    assert sel.filter_mailbox(f.tickets, f.mailboxes, Params(mailbox_id=2)).count() == 0
    portals = spark.createDataFrame([("acme",)], "name string")
    with pytest.raises(ValueError, match="acme"):
        sel.require_portal(portals, Params(portal_name="other"))
    sel.require_portal(portals, Params(portal_name="ACME"))


def test_comments_of_one_post_id_in_two_portals(spark):
    f = feeds(spark, [], [post(7, "x", portal="a"), post(7, "y", portal="b")])
    comments = spark.createDataFrame([("a", 7, 1, "user", "only a", None)],
                                     "portal string, post_id bigint, pos bigint, role string, comment string, created_at string")
    rows = sel.request_comment_rows(f.posts.drop("created_at"), comments)
    assert sorted((r.title, r.comment) for r in rows.collect()) == [("x", "only a"), ("y", None)]
    lists = {r.title: len(r.comments) for r in sel.attach_comment_list(f.posts, comments).collect()}
    assert lists == {"x": 1, "y": 0}
