"""Adapters from the driver's tables to the two feeds (FIXTURES.md part B).

* tickets  <- documents      (subject = first line, preview = the whole text)
* posts    <- conversations  (title = first user turn, description = first
                              assistant turn, comments = every later turn)
* mailboxes <- region, portals <- the posts' portal names

Texts are carried whole; nothing is cut to a prefix.  All derivations are
narrow projections except the per-conversation aggregate that builds a post,
which is a partial+final hash aggregate on ``conv_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.params import FIXTURE_AS_OF

# Fixture derivation constants (FIXTURES.md B1/B2).
TICKET_SPREAD_MINUTES = 86_400   # tickets span 60 days before as_of
POST_SPREAD_MINUTES = 172_800    # posts span 120 days before as_of
MIX = 7_919
N_MAILBOXES = 5
N_PORTALS = 3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash-spread a scan whose rows arrive in fewer splits than the cluster has cores.

    Regex redaction over whole texts is CPU-bound; a file read as one
    split would run it in one task.  A large file is cut into many splits, but all rows
    of a row group come in one of them, so the splits that hold rows count
    (a scan without columns tells them).  Others pass through untouched.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores or df.select(F.spark_partition_id().alias("p")).distinct().count() < cores:
        # a few very long texts dominate: more, smaller tasks balance the load
        return df.repartition(cores * 4, key)
    return df


def text_table(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    return spread(table(spark, sf_dir, name), key)


def _portal(conv_id: Column) -> Column:
    return F.concat(F.lit("portal_"), (conv_id % N_PORTALS).cast("string"))


def _as_of() -> Column:
    return F.lit(FIXTURE_AS_OF).cast("timestamp_ntz")


def tickets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw tickets ``(id, number, subject, preview, status, mailbox_id,
    created_at, closed_at, tags, threads, customer_email)``."""
    d = text_table(spark, sf_dir, "documents", "doc_id")
    minutes = ((F.col("doc_id") * MIX) % TICKET_SPREAD_MINUTES).cast("int")
    return d.select(
        F.col("doc_id").alias("id"),
        F.col("doc_id").alias("number"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("subject"),
        F.col("text").alias("preview"),
        F.lit("active").alias("status"),
        (F.col("doc_id") % N_MAILBOXES).alias("mailbox_id"),
        (_as_of() - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("Bug"), F.lit("urgent")))
        .when(F.col("doc_id") % 11 == 0, F.array(F.lit("vip"), F.lit("Escalation")))
        .otherwise(F.array().cast("array<string>")).alias("tags"),
        (F.col("doc_id") % 8).cast("int").alias("threads"),
        F.lit(None).cast("string").alias("customer_email"),
    )


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw posts ``(id, title, description, portal, status, category,
    votes_count, comments_count, created_at, updated_at, url, feed_seq)``."""
    c = table(spark, sf_dir, "conversations")
    first_user = F.min(F.when(F.col("role") == "user", F.struct("turn", "text")))["text"]
    first_asst = F.min(F.when(F.col("role") == "assistant", F.struct("turn", "text")))["text"]
    g = c.groupBy("conv_id").agg(
        first_user.alias("title"),
        F.coalesce(first_asst, F.lit("")).alias("description"),
        F.count(F.when(F.col("turn") > 0, 1)).alias("comments_count"),
    )
    minutes = ((F.col("conv_id") * MIX) % POST_SPREAD_MINUTES).cast("int")
    created = _as_of() - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))
    return g.select(
        F.col("conv_id").alias("id"),
        F.col("title"),
        F.col("description"),
        _portal(F.col("conv_id")).alias("portal"),
        F.when(F.col("conv_id") % 4 == 0, "Open").when(F.col("conv_id") % 4 == 1, "Planned")
        .when(F.col("conv_id") % 4 == 2, "Completed").alias("status"),
        F.lit(None).cast("string").alias("category"),
        ((F.col("conv_id") * 37) % 101).alias("votes_count"),
        F.col("comments_count"),
        created.alias("created_at"),
        created.alias("updated_at"),
        F.lit(None).cast("string").alias("url"),
        F.col("conv_id").alias("feed_seq"),
    )


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comments ``(portal, post_id, pos, role, comment, created_at)``; never names."""
    c = text_table(spark, sf_dir, "conversations", "conv_id")
    return c.filter(F.col("turn") > 0).select(
        _portal(F.col("conv_id")).alias("portal"),
        F.col("conv_id").alias("post_id"),
        F.col("turn").alias("pos"),
        F.when(F.col("role") == "assistant", "admin").otherwise("user").alias("role"),
        F.col("text").alias("comment"),
        F.lit(None).cast("string").alias("created_at"),
    )


def mailboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes ``(id, name, pos)`` from ``region``; ``pos`` is listing order."""
    r = table(spark, sf_dir, "region")
    return r.select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"),
                    F.col("r_regionkey").alias("pos"))


def portals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Portal dimension ``(name, base_url)`` derived from the posts.

    Portal config order is name order.  The distinct is a partial aggregate, so
    its shuffle carries one row per portal per map task.
    """
    p = posts(spark, sf_dir).select("portal").distinct()
    return p.select(F.col("portal").alias("name"),
                    F.concat(F.lit("https://"), F.col("portal"), F.lit(".example.invalid")).alias("base_url"))
