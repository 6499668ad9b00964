"""Landed API pages -> rows.

Ticket, mailbox and post pages are read with declared schemas (no inference)
and exploded; a page without ``_embedded`` contributes no rows, and all pages
are appended without dedupe.  A page that is no JSON gives no rows but a
warning (:func:`page_warnings`); pretty-printed pages need ``multi_line``.
``source_status`` isolates failures per source the way the service does: one
failed source is a warning row, the others proceed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmesh.functions import pii

PAGE_INFO = T.StructType([T.StructField(n, T.LongType()) for n in ("totalElements", "totalPages", "number", "size")])

CONVERSATION = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("number", T.LongType()), T.StructField("subject", T.StringType()),
    T.StructField("status", T.StringType()), T.StructField("state", T.StringType()),
    T.StructField("mailboxId", T.LongType()), T.StructField("createdAt", T.StringType()),
    T.StructField("closedAt", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StructType([T.StructField("id", T.LongType()),
                                                    T.StructField("tag", T.StringType())]))),
    T.StructField("primaryCustomer", T.StructType([T.StructField("email", T.StringType())])),
    T.StructField("preview", T.StringType()), T.StructField("threads", T.IntegerType()),
])
TICKET_PAGE = T.StructType([
    T.StructField("_embedded", T.StructType([T.StructField("conversations", T.ArrayType(CONVERSATION))])),
    T.StructField("page", PAGE_INFO),
])
MAILBOX_PAGE = T.StructType([
    T.StructField("_embedded", T.StructType([T.StructField("mailboxes", T.ArrayType(T.StructType([
        T.StructField("id", T.LongType()), T.StructField("name", T.StringType())])))])),
    T.StructField("page", PAGE_INFO),
])
NAMED = T.StructType([T.StructField("id", T.LongType()), T.StructField("name", T.StringType()),
                      T.StructField("color", T.StringType())])
POST = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("title", T.StringType()),
    T.StructField("description", T.StringType()), T.StructField("status", NAMED), T.StructField("category", NAMED),
    T.StructField("votes_count", T.LongType()), T.StructField("comments_count", T.LongType()),
    T.StructField("created_at", T.StringType()), T.StructField("updated_at", T.StringType()),
    T.StructField("url", T.StringType()),
])
POST_PAGE = T.StructType([
    T.StructField("data", T.ArrayType(POST)), T.StructField("hasMore", T.BooleanType()),
    T.StructField("total", T.LongType()), T.StructField("skip", T.LongType()), T.StructField("limit", T.LongType()),
])


def ticket_rows(pages: DataFrame, page_no: Column | None = None) -> DataFrame:
    """``pages`` has a ``page`` struct column of TICKET_PAGE (+ optional page number)."""
    base = pages.select((page_no if page_no is not None else F.lit(0)).alias("page_no"),
                        F.posexplode(F.coalesce(F.col("p._embedded.conversations"),
                                                F.array().cast(T.ArrayType(CONVERSATION)))).alias("page_pos", "c"))
    return base.select(
        "page_no", "page_pos", F.col("c.id").alias("id"), F.col("c.number").alias("number"),
        F.col("c.subject").alias("subject"), F.col("c.preview").alias("preview"), F.col("c.status").alias("status"),
        F.col("c.mailboxId").alias("mailbox_id"), F.col("c.createdAt").alias("created_at"),
        F.col("c.closedAt").alias("closed_at"), F.col("c.tags").alias("tags"), F.col("c.threads").alias("threads"),
        F.lit(None).cast("string").alias("customer_email"),  # never carried past the reader
    )


CORRUPT = "_corrupt_record"


def read_raw(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Landed records as they are, those that are no page of ``schema`` with their text in ``CORRUPT``."""
    return (spark.read.schema(T.StructType([*schema, T.StructField(CORRUPT, T.StringType())])).option("mode", "PERMISSIVE")
            .option("columnNameOfCorruptRecord", CORRUPT).option("multiLine", multi_line).json(path))


def read_pages(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Landed pages as ``page_no, p``: one page a line, or one page a file with ``multi_line``."""
    return as_pages(read_raw(spark, path, schema, multi_line), schema)


def as_pages(raw: DataFrame, schema: T.StructType) -> DataFrame:
    number = F.coalesce(F.col("page.number"), F.lit(0)) if "page" in schema.names else F.lit(0)
    return raw.select(number.alias("page_no"), F.struct(*schema.names).alias("p"))


def page_warnings(spark: SparkSession, path: str, schema: T.StructType, source: str, multi_line: bool = False) -> DataFrame:
    """One row ``source, warning`` per landed record that is not a page of ``schema``."""
    raw = read_raw(spark, path, schema, multi_line)
    return raw.filter(F.col(CORRUPT).isNotNull()).select(
        F.lit(source).alias("source"),
        F.concat(F.lit(f"{source}: unreadable page in "), F.col("_metadata.file_name")).alias("warning"),
        F.to_json(F.struct(*schema.names)).alias("read_as"))


def read_ticket_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return ticket_rows(read_pages(spark, path, TICKET_PAGE, multi_line), F.col("page_no"))


def read_mailbox_pages(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    return mailbox_rows(read_pages(spark, path, MAILBOX_PAGE, multi_line))


def read_post_pages(spark: SparkSession, path: str, portal: str, multi_line: bool = False) -> DataFrame:
    return post_rows(read_pages(spark, path, POST_PAGE, multi_line), F.lit(portal))


def mailbox_rows(pages: DataFrame) -> DataFrame:
    """S3: ``(id, name, pos)``; ``pos`` keeps listing order for name resolution."""
    ex = pages.select(F.col("page_no"), F.posexplode(F.coalesce(F.col("p._embedded.mailboxes"), F.array().cast(
        MAILBOX_PAGE["_embedded"].dataType["mailboxes"].dataType))).alias("i", "m"))
    return ex.select(F.col("m.id").alias("id"), F.col("m.name").alias("name"),
                     (F.col("page_no") * 1_000_000 + F.col("i")).alias("pos"))


def post_rows(pages: DataFrame, portal: Column) -> DataFrame:
    """Posts in feed order (``feed_seq`` = skip + position), stamped with
    the portal they were read from."""
    ex = pages.select(F.col("p.skip").alias("skip"),
                      F.posexplode(F.coalesce(F.col("p.data"), F.array().cast(T.ArrayType(POST)))).alias("i", "x"),
                      portal.alias("portal"))
    return ex.select(F.col("x.id").alias("id"), F.col("x.title").alias("title"),
                     F.col("x.description").alias("description"), "portal", F.col("x.status").alias("status"),
                     F.col("x.category").alias("category"), F.col("x.votes_count").alias("votes_count"),
                     F.col("x.comments_count").alias("comments_count"), F.col("x.created_at").alias("created_at"),
                     F.col("x.updated_at").alias("updated_at"), F.col("x.url").alias("url"),
                     (F.coalesce(F.col("skip"), F.lit(0)) + F.col("i")).alias("feed_seq"))


def source_status(spark: SparkSession, loaders: dict) -> DataFrame:
    """Try every source; a failure becomes a scrubbed warning row.

    ``loaders`` maps a source name to a zero-argument callable returning a
    DataFrame; only the schema is resolved here (no data is read).
    """
    rows = []
    for name, load in loaders.items():
        try:
            load().schema  # noqa: B018 - resolves the plan / files
            rows.append((name, True, None))
        except Exception as exc:  # noqa: BLE001 - isolation is the point
            rows.append((name, False, f"{name} fetch failed: {exc}"))
    df = spark.createDataFrame(rows, "source string, ok boolean, warning string")
    return pii.with_scrub(df, "warning", "warning_s", "_pii").select(
        "source", "ok", F.when(F.col("warning").isNotNull(), F.col("warning_s")).alias("warning"))


def run_failed(status: DataFrame, tickets_source: str, portal_sources: list[str], n_requests: int = 0) -> bool:
    """Total failure: tickets failed, and no portals or no requests with at least one failed portal."""
    rows = {r.source: r.ok for r in status.collect()}
    tickets_failed = not rows.get(tickets_source, False)
    return tickets_failed and (not portal_sources or (
        n_requests == 0 and not all(rows.get(p, False) for p in portal_sources)))
