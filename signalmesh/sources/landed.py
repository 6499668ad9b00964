"""Landed feeds as job inputs, each source isolated.

Every source is a folder of landed pages.  It is read once: its rows are
parsed, written to the shared folder, and the pages and unreadable pages met on
the way are counted in the same pass (observed metrics).  An unreadable page
costs its own rows and gives a warning; a source that cannot be read at all
gives a warning and no rows; the others go on.  The run fails only when the
ticket feed failed and there are no portals, or no requests and a failed portal.

Warnings are scrubbed before they leave.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmesh.functions import pii
from signalmesh.session import materialize
from signalmesh.sources import pages as pg

TICKETS = "support_tickets"
STATUS = "source string, ok boolean, pages bigint, unreadable_pages bigint, warning string"
COMMENT_FIELDS = "struct<comment:string,author:struct<role:string>,created_at:string>"
#: Sources read at the same time (each is a Spark job of its own).
AT_ONCE = 4


@dataclass(frozen=True)
class Source:
    """One landed source: its pages' folder, their schema, and how a page becomes rows."""

    name: str
    path: str
    schema: T.StructType
    rows: Callable[[DataFrame], DataFrame]
    multi_line: bool = False


def ticket_source(path: str, multi_line: bool = False) -> Source:
    return Source(TICKETS, path, pg.TICKET_PAGE, lambda pages: pg.ticket_rows(pages, F.col("page_no")), multi_line)


def mailbox_source(path: str, multi_line: bool = False) -> Source:
    return Source("mailboxes", path, pg.MAILBOX_PAGE, pg.mailbox_rows, multi_line)


def portal_source(portal: str, path: str, multi_line: bool = False) -> Source:
    return Source(portal, path, pg.POST_PAGE, lambda pages: pg.post_rows(pages, F.lit(portal)), multi_line)


def read_source(spark: SparkSession, source: Source) -> tuple[DataFrame | None, tuple]:
    """The source's rows (written; none if it failed) and its status, from one pass."""
    seen = Observation(f"landed-{uuid.uuid4().hex[:12]}")
    try:
        raw = pg.read_raw(spark, source.path, source.schema, source.multi_line).observe(
            seen, F.count(F.lit(1)).alias("pages"), F.count(pg.CORRUPT).alias("bad"))
        rows = materialize(source.rows(pg.as_pages(raw, source.schema)), f"landed-{source.name}")
    except PySparkException as exc:
        first = next(iter(str(exc).splitlines()), "")
        return None, (source.name, False, 0, 0, f"{source.name} fetch failed: {first}")
    pages, bad = seen.get["pages"], seen.get["bad"]
    warning = f"{source.name}: {bad} of {pages} pages unreadable" if bad else None
    return rows, (source.name, True, pages, bad, warning)


def status_table(spark: SparkSession, status: list[tuple]) -> DataFrame:
    """``source, ok, pages, unreadable_pages, warning`` (scrubbed), one row a source."""
    return pii.with_scrub(spark.createDataFrame(status, STATUS), "warning", "warning_s", "_pii").select(
        "source", "ok", "pages", "unreadable_pages", F.when(F.col("warning").isNotNull(), F.col("warning_s")).alias("warning"))


@dataclass
class Landed:
    tickets: DataFrame
    posts: DataFrame
    mailboxes: DataFrame
    comments: DataFrame
    portals: DataFrame
    status: DataFrame


def _none(spark: SparkSession, source: Source) -> DataFrame:
    """No rows, in the columns of the source."""
    page = spark.createDataFrame([], T.StructType([T.StructField("page_no", T.LongType()), T.StructField("p", source.schema)]))
    return source.rows(page)


def read_landed(spark: SparkSession, tickets: str, mailboxes: str, portals: list[tuple[str, str, str]],
                comments: dict[str, str] | None = None, multi_line: bool = False) -> Landed:
    """All feeds of a run. ``portals``: ``name, base url, folder`` in configured order; ``comments``: folder of comment payloads by portal.

    Raises when the ticket feed failed and there are no portals, or no requests
    and a failed portal; the message holds every warning.
    """
    sources = [ticket_source(tickets, multi_line), mailbox_source(mailboxes, multi_line),
               *[portal_source(name, path, multi_line) for name, _, path in portals]]
    with ThreadPoolExecutor(AT_ONCE) as pool:
        read = list(pool.map(lambda s: read_source(spark, s), sources))
    status = [told for _, told in read]
    rows = [df if df is not None else _none(spark, s) for (df, _), s in zip(read, sources)]
    posts = rows[2] if portals else _none(spark, portal_source("", "")).limit(0)
    for more in rows[3:]:
        posts = posts.unionByName(more)
    portal_failed = any(not ok for _, ok, *_ in status[2:])
    if not status[0][1] and (not portals or (portal_failed and posts.isEmpty())):
        scrubbed = [r.warning for r in status_table(spark, status).collect() if r.warning]
        raise ValueError("no feed could be read: " + "; ".join(scrubbed))
    order = spark.createDataFrame([(name, url, i) for i, (name, url, _) in enumerate(portals)], "name string, base_url string, pos int")
    said = None
    for name, path in (comments or {}).items():
        part = comment_rows(spark.read.json(path, schema="post_id string, payload string"), F.lit(name))
        said = part if said is None else said.unionByName(part)
    if said is None:
        said = comment_rows(spark.createDataFrame([], "post_id string, payload string"), F.lit(""))
    return Landed(rows[0], posts, rows[1], said, order, status_table(spark, status))


def comment_rows(payloads: DataFrame, portal: Column | None = None) -> DataFrame:
    """``portal, post_id, pos, role, comment, created_at`` of comment payloads (``post_id, payload``).

    A payload's ``data`` is an array of comments or a single one; one that is
    missing, null or unreadable gives no rows.  Names and ids of authors are
    never read.
    """
    data = F.try_variant_get(F.try_parse_json("payload"), "$.data", "variant")
    many = F.startswith(F.schema_of_variant(data), F.lit("ARRAY"))
    single = F.startswith(F.schema_of_variant(data), F.lit("OBJECT"))
    listed = (F.when(many, F.try_variant_get(data, "$", f"array<{COMMENT_FIELDS}>"))
              .when(single, F.array(F.try_variant_get(data, "$", COMMENT_FIELDS))))
    out = payloads.select((F.col("portal") if portal is None else portal).alias("portal"), "post_id", F.posexplode(listed).alias("pos", "c"))
    return out.filter("c is not null").select("portal", "post_id", F.col("pos").cast("bigint").alias("pos"), F.col("c.author.role").alias("role"),
                                              F.col("c.comment").alias("comment"), F.col("c.created_at").alias("created_at"))
