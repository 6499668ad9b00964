"""Format layer and signal normalisation: F6-F9, F12, U1.

Scrubbing happens here, before any text reaches analysis.  Privacy drops are
explicit projections: no customer e-mail, commenter name or id leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from signalmesh.functions import pii
from signalmesh.functions.text import collapse_ws, collapsed_quote, request_quote_text, ticket_quote

#: A request's place in its feed, where known: the portal's place in the configuration, then the selection's keys.
PLACE = ("portal_pos", "feed_seq", "grp", "k1", "k2")
COMMENT_TYPE = "array<struct<role:string,comment:string,created_at:string>>"

ORD_TYPE = T.StructType([
    T.StructField("src", T.IntegerType()),
    T.StructField("portal", T.StringType()),
    T.StructField("grp", T.IntegerType()),
    T.StructField("k1", T.LongType()),
    T.StructField("k2", T.LongType()),
])


def _names(c: Column, dtype: T.DataType) -> Column:
    """Flatten ``{id,name,..}`` or ``{id,tag}`` structs to their text; strings pass."""
    if isinstance(dtype, T.StructType):
        field = "name" if "name" in dtype.fieldNames() else "tag"
        return c[field]
    return c


def to_ntz(c: Column, dtype: T.DataType) -> Column:
    """A date as UTC wall time: offsets are honoured, unreadable strings become null."""
    if isinstance(dtype, T.StringType):
        return F.try_to_timestamp(c).cast("timestamp_ntz")
    if isinstance(dtype, T.TimestampType):
        return c.cast("timestamp_ntz")
    return c


def _by_field(**found: str) -> Column:
    """Each scrubbed field with the categories found in it, as an array of ``field, category``."""
    return F.concat(*[_named(field, c) for field, c in found.items()])


def _named(field: str, found: str) -> Column:
    return F.transform(found, lambda x: F.struct(F.lit(field).alias("field"), x.alias("category")))


def tickets_clean(raw: DataFrame) -> DataFrame:
    """scrub subject and preview, redact the customer e-mail, flatten tags."""
    s = raw.schema
    tags = F.col("tags")
    tag_t = s["tags"].dataType
    if isinstance(tag_t, T.ArrayType) and isinstance(tag_t.elementType, T.StructType):
        tags = F.transform(tags, lambda t: t["tag"])
    df = raw.select(
        F.col("id"), F.col("number"), F.col("subject"), F.col("preview"), F.col("status"),
        to_ntz(F.col("created_at"), s["created_at"].dataType).alias("created_at"),
        to_ntz(F.col("closed_at"), s["closed_at"].dataType).alias("closed_at"),
        F.coalesce(tags, F.array().cast("array<string>")).alias("tags"),
        F.coalesce(F.col("threads"), F.lit(0)).cast("int").alias("thread_count"),
        *[F.col(c) for c in ("mailbox_id",) if c in raw.columns],
    )
    df = pii.with_scrub(df, "subject", "subject_s", "pii_subject")
    df = pii.with_scrub(df, "preview", "preview_s", "pii_preview")
    has_preview = F.coalesce(F.col("preview"), F.lit("")) != ""
    return df.select(
        "id", "number",
        F.col("subject_s").alias("subject"),
        "status", "created_at", "closed_at",
        F.lit("[REDACTED]").alias("customer_email"),
        "tags",
        F.col("preview_s").alias("preview"),
        F.when(has_preview, F.array(F.col("preview_s"))).otherwise(F.array().cast("array<string>"))
        .alias("customer_messages"),
        "thread_count",
        *[c for c in ("mailbox_id",) if c in raw.columns],
        F.array_sort(F.array_distinct(F.concat("pii_subject", "pii_preview"))).alias("pii"),
        _by_field(subject="pii_subject", preview="pii_preview").alias("pii_fields"),
    )


def requests_clean(raw: DataFrame) -> DataFrame:
    """scrub title/description/comments; keep role, text, time of comments."""
    s = raw.schema
    comments = F.col("comments") if "comments" in raw.columns else F.lit(None).cast(COMMENT_TYPE)
    if "comments" in raw.columns:
        el = s["comments"].dataType.elementType
        if "author" in el.fieldNames():
            comments = F.transform(comments, lambda c: F.struct(c["author"]["role"].alias("role"),
                                                                 c["comment"].alias("comment"),
                                                                 c["created_at"].cast("string").alias("created_at")))
    df = raw.select(
        F.col("id"), F.col("title"), F.col("description"),
        _names(F.col("status"), s["status"].dataType).alias("status"),
        _names(F.col("category"), s["category"].dataType).alias("category"),
        F.coalesce(F.col("votes_count"), F.lit(0)).cast("bigint").alias("votes_count"),
        F.coalesce(F.col("comments_count"), F.lit(0)).cast("bigint").alias("comments_count"),
        F.col("portal"), F.col("url"),
        to_ntz(F.col("created_at"), s["created_at"].dataType).alias("created_at"),
        to_ntz(F.col("updated_at"), s["updated_at"].dataType).alias("updated_at"),
        F.coalesce(comments, F.array().cast(COMMENT_TYPE)).alias("comments"),
        *[F.col(c) for c in PLACE if c in raw.columns],
    )
    df = pii.with_scrub(df, "title", "title_s", "pii_title")
    df = pii.with_scrub(df, "description", "desc_s", "pii_desc")
    scrubbed = F.transform(F.col("comments"), lambda c: F.struct(c["role"].alias("role"),
                                                                  pii.scrub_expr(c["comment"]).alias("s"),
                                                                  c["created_at"].alias("created_at")))
    df = df.withColumn("__cs", scrubbed)
    return df.select(
        "id", F.col("title_s").alias("title"), F.col("desc_s").alias("description"), "status", "category",
        "votes_count", "comments_count", "portal", "url", "created_at", "updated_at",
        F.transform("__cs", lambda c: F.struct(c["role"].alias("role"), c["s"]["text"].alias("comment"),
                                               c["created_at"].alias("created_at"))).alias("comments"),
        *[c for c in PLACE if c in raw.columns],
        F.array_sort(F.array_distinct(F.concat("pii_title", "pii_desc",
                                               F.flatten(F.transform("__cs", lambda c: c["s"]["pii"])))))
        .alias("pii"),
        F.concat(_by_field(title="pii_title", description="pii_desc"), F.transform(
            F.array_sort(F.array_distinct(F.flatten(F.transform("__cs", lambda c: c["s"]["pii"])))),
            lambda x: F.struct(F.lit("comments").alias("field"), x.alias("category")))).alias("pii_fields"),
    )


def _micros(ts: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def ticket_ord() -> Column:
    """Tickets come first, newest first (the feed is sorted by createdAt desc)."""
    newest_first = F.coalesce(-_micros(F.col("created_at")), F.lit(2 ** 62).cast("bigint"))
    return F.struct(F.lit(0).alias("src"), F.lit("").alias("portal"), F.lit(0).alias("grp"),
                    newest_first.alias("k1"), F.col("id").cast("bigint").alias("k2"))


def request_ord(configured: bool = False) -> Column:
    """Requests after tickets: portal order, recent (feed order) then top-voted.

    Portals come in the order they are ``configured`` in (``portal_pos``), else by name.
    """
    portal = F.concat(F.format_string("%09d ", F.col("portal_pos").cast("int")), F.col("portal")) if configured else F.col("portal")
    return F.struct(F.lit(1).alias("src"), portal.alias("portal"), F.col("grp").cast("int").alias("grp"),
                    F.col("k1").cast("bigint").alias("k1"), F.col("k2").cast("bigint").alias("k2"))


SIGNAL_COLUMNS = ("id", "source", "title", "body", "msg_dup", "msgs", "first_comment", "created_at", "tags",
                  "thread_count", "votes", "comments_count", "portal", "ord", "pii", "pii_fields")


def signal_text() -> Column:
    """F8/F9 text: lower(title, body, messages) -- a ticket's preview appears twice
    (it is also its only customer message), a request's comments all follow."""
    return F.lower(F.concat_ws(" ", F.col("title"), F.col("body"),
                               F.when(F.col("msg_dup"), F.col("body")), F.col("msgs")))


def with_text(signals: DataFrame) -> DataFrame:
    return signals if "text" in signals.columns else signals.withColumn("text", signal_text())


def signal_quote(message: Column | None = None) -> Column:
    """X17 for any signal (evaluated only where a quote is needed); ``message``: :func:`first_message` as a column."""
    ticket = ticket_quote(F.when(F.col("msg_dup"), F.col("body")), F.col("title")) if message is None else collapsed_quote(message, F.col("title"))
    return F.when(F.col("source") == "REACTIVE", ticket).otherwise(
        request_quote_text(F.col("first_comment"), F.col("title"), F.col("votes")))


def first_message() -> Column:
    """A ticket's first message, whitespace collapsed; empty without one."""
    return collapse_ws(F.when((F.col("source") == "REACTIVE") & F.col("msg_dup"), F.coalesce("body", F.lit(""))).otherwise(F.lit("")))


def ticket_signals(tc: DataFrame) -> DataFrame:
    """F8: id ``hs-<id>``; the text is derived by :func:`signal_text`."""
    return tc.select(
        F.concat(F.lit("hs-"), F.col("id").cast("string")).alias("id"),
        F.lit("REACTIVE").alias("source"),
        F.col("subject").alias("title"),
        F.col("preview").alias("body"),
        (F.size("customer_messages") > 0).alias("msg_dup"),
        F.lit(None).cast("array<string>").alias("msgs"),
        F.lit(None).cast("string").alias("first_comment"),
        F.col("created_at"),
        F.col("tags"),
        F.col("thread_count"),
        F.lit(None).cast("bigint").alias("votes"),
        F.lit(None).cast("bigint").alias("comments_count"),
        F.lit(None).cast("string").alias("portal"),
        ticket_ord().alias("ord"),
        F.col("pii"),
        F.col("pii_fields"),
    )


def request_signals(rc: DataFrame) -> DataFrame:
    """id ``pl-<id>``; text over title, description and every comment."""
    first = F.get(F.filter("comments", lambda c: ~F.coalesce(c["role"] == "admin", F.lit(False))), 0)
    return rc.select(
        F.concat(F.lit("pl-"), F.col("id").cast("string")).alias("id"),
        F.lit("PROACTIVE").alias("source"),
        F.col("title"),
        F.col("description").alias("body"),
        F.lit(False).alias("msg_dup"),
        F.transform("comments", lambda c: c["comment"]).alias("msgs"),
        first["comment"].alias("first_comment"),
        F.col("created_at"),
        F.lit(None).cast("array<string>").alias("tags"),
        F.lit(None).cast("int").alias("thread_count"),
        F.col("votes_count").alias("votes"),
        F.col("comments_count"),
        F.col("portal"),
        request_ord("portal_pos" in rc.columns).alias("ord"),
        F.col("pii"),
        F.col("pii_fields"),
    )


def all_signals(tickets_sig: DataFrame, requests_sig: DataFrame) -> DataFrame:
    """Bag union of both feeds."""
    return tickets_sig.select(*SIGNAL_COLUMNS).unionByName(requests_sig.select(*SIGNAL_COLUMNS))


def pii_run_categories(*cleaned: DataFrame) -> DataFrame:
    """distinct categories over every scrubbed field of a run, sorted."""
    out = None
    for df in cleaned:
        part = df.select(F.explode("pii").alias("category"))
        out = part if out is None else out.unionByName(part)
    return out.distinct()
