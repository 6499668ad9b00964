"""Feed selection: F1-F5, W2, W3, S5/J4, J5, U2.

Scale notes
* F1/F2 are range predicates on the scan -> Parquet pushdown.
* W2 (top-N per portal) is ``row_number <= N``; Catalyst plans it with a
  ``WindowGroupLimit`` before the shuffle, so each map task ships at most N
  rows per portal even when one portal holds most posts.
* W3 is one scan and two windows: a post is a candidate as a recent one, as a
  top-voted one or as both, and one ``row_number <= N`` bounds both kinds ahead
  of the shuffle.  Nothing is joined.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from signalmesh.operators.normalize import to_ntz
from signalmesh.params import Params


def _as_of(p: Params):
    return F.lit(p.as_of).cast("timestamp_ntz")


def window_start(p: Params):
    return _as_of(p) - F.make_dt_interval(F.lit(p.timeframe_days))


def _created(df: DataFrame) -> Column:
    return to_ntz(F.col("created_at"), df.schema["created_at"].dataType)


def tickets_in_window(tickets: DataFrame, p: Params) -> DataFrame:
    """F1 (+F3): createdAt in the closed range [as_of - N days, as_of]; unparseable dates drop."""
    out = tickets.filter(_created(tickets).between(window_start(p), _as_of(p)))
    if p.mailbox_id is not None:
        out = out.filter(F.col("mailbox_id") == F.lit(p.mailbox_id))
    return out


def resolve_mailbox(mailboxes: DataFrame, p: Params) -> DataFrame:
    """Name -> id (case-insensitive, first in listing order); explicit id wins.

    Returns a one-row ``(mailbox_id)`` frame, empty when nothing matches.
    """
    if p.mailbox_id is not None:
        return mailboxes.sparkSession.range(1).select(F.lit(p.mailbox_id).cast("bigint").alias("mailbox_id"))
    hit = mailboxes.filter(F.lower(F.col("name")) == F.lower(F.lit(p.mailbox_name or "")))
    return hit.agg(F.min_by("id", "pos").alias("mailbox_id")).filter(F.col("mailbox_id").isNotNull())


def filter_mailbox(tickets: DataFrame, mailboxes: DataFrame, p: Params) -> DataFrame:
    """F3 with J5: restrict tickets to the resolved mailbox (no name/id = all).

    A name is resolved first (one row), so the scan sees a plain equality;
    an unknown name is an error that lists the mailboxes.
    """
    if p.mailbox_id is None and not p.mailbox_name:
        return tickets
    hit = resolve_mailbox(mailboxes, p).first()
    if hit is None:
        raise ValueError(f'no mailbox named "{p.mailbox_name}"; available: {_listed(mailboxes.orderBy("pos"))}')
    return tickets.filter(F.col("mailbox_id") == F.lit(hit.mailbox_id))


def _listed(named: DataFrame, most: int = 100) -> str:
    return ", ".join(str(r.name) for r in named.select("name").limit(most).collect())


def require_portal(portals: DataFrame, p: Params) -> None:
    """An unknown portal name is an error that lists the portals."""
    if p.portal and portals.filter(F.lower(F.col("name")) == F.lower(F.lit(p.portal))).isEmpty():
        raise ValueError(f'no portal named "{p.portal}"; available: {_listed(portals.orderBy("name"))}')


def filter_portal(posts: DataFrame, p: Params) -> DataFrame:
    """case-insensitive portal equality; empty = all."""
    if not p.portal:
        return posts
    return posts.filter(F.lower(F.col("portal")) == F.lower(F.lit(p.portal)))


def filter_status(posts: DataFrame, p: Params) -> DataFrame:
    """case-insensitive status equality; null status never matches."""
    if not p.status_filter:
        return posts
    status = F.col("status")
    if "name" in getattr(posts.schema["status"].dataType, "names", []):
        status = status["name"]
    return posts.filter(F.lower(status) == F.lower(F.lit(p.status_filter)))


def recent_posts(posts: DataFrame, p: Params) -> DataFrame:
    """created_at >= as_of - N days, no upper bound; unparseable dates drop."""
    return posts.filter(_created(posts) >= window_start(p))


def top_voted_posts(posts: DataFrame, p: Params) -> DataFrame:
    """Per portal the N most-voted posts (null votes = 0), ties in feed order."""
    w = Window.partitionBy("portal").orderBy(F.coalesce(F.col("votes_count"), F.lit(0)).desc(),
                                             F.col("feed_seq").asc())
    return posts.withColumn("vote_rank", F.row_number().over(w)).filter(F.col("vote_rank") <= p.top_voted_limit)


def selected_posts(posts: DataFrame, p: Params) -> DataFrame:
    """Per portal, recent posts (feed order) then top-voted ones not already
    taken (vote order); duplicates by id keep the first.

    Adds the ordering columns ``grp, k1, k2`` used by :func:`request_ord`.
    """
    posts = filter_portal(posts, p)
    votes = F.coalesce(F.col("votes_count"), F.lit(0)).cast("bigint")
    seq = F.col("feed_seq").cast("bigint")
    grp = F.col("grp")
    recent = F.coalesce(_created(posts) >= window_start(p), F.lit(False))
    cands = (posts.withColumn("grp", F.explode(F.when(recent, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))))
             .withColumn("k1", F.when(grp == 0, seq).otherwise(-votes)).withColumn("k2", F.when(grp == 0, F.lit(0).cast("bigint")).otherwise(seq)))
    # recent posts compete within their id (the first stays), top-voted ones within their portal (N stay)
    best = Window.partitionBy("portal", "grp", F.when(grp == 0, F.col("id"))).orderBy("k1", "k2")
    cands = cands.withColumn("__r", F.row_number().over(best)).filter((F.col("__r") <= p.top_voted_limit) & ((grp == 1) | (F.col("__r") == 1)))
    first = Window.partitionBy("portal", "id").orderBy("grp", "k1", "k2")
    return cands.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") == 1).drop("__r")


def attach_comment_list(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """S5/J4 (array form): ``comments`` ordered by position; none -> empty list.

    Report-size helper: a post's whole comment list becomes one row, so use it
    only where posts are known to be small (tests, single-post views).  Jobs
    that scale with comment volume use :func:`request_comment_rows` (long
    form) or per-post aggregates.
    """
    grouped = comments.groupBy("portal", F.col("post_id").alias("id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "role", "comment", "created_at"))).alias("__c"))
    joined = posts.join(grouped, ["portal", "id"], "left")
    return joined.withColumn(
        "comments",
        F.coalesce(F.transform("__c", lambda c: F.struct(c["role"].alias("role"), c["comment"].alias("comment"),
                                                         c["created_at"].alias("created_at"))),
                   F.array().cast("array<struct<role:string,comment:string,created_at:string>>")),
    ).drop("__c")


def request_comment_rows(posts: DataFrame, comments: DataFrame) -> DataFrame:
    """J4 (long form): post LEFT JOIN comments, one row per comment (or one
    null-comment row for a post without comments).  Post ids repeat across
    portals, so both are the key."""
    return posts.join(comments.withColumnRenamed("post_id", "id"), ["portal", "id"], "left")


def all_portals(*per_portal: DataFrame) -> DataFrame:
    """Bag union over portals (the same id in two portals stays twice)."""
    out = per_portal[0]
    for df in per_portal[1:]:
        out = out.unionByName(df)
    return out
