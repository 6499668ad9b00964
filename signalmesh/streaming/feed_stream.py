"""Streaming form of the per-row stages.

The source service has no stream operator: each call is a batch over a
look-back window.  Redaction, normalisation and theme tagging are stateless
per row, so the same column functions run unchanged on ``readStream``; the
scored analysis stays a batch job over the accumulated table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.config import ThemesConfig
from signalmesh.operators import normalize as nz
from signalmesh.operators import themes as th
from signalmesh.sources.fixtures import TICKET_SPREAD_MINUTES, MIX, N_MAILBOXES
from signalmesh.params import FIXTURE_AS_OF


def document_stream(spark: SparkSession, sf_dir: str, max_files: int = 1) -> DataFrame:
    """Documents as a file stream (schema taken from the batch table)."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # a file stream watches a folder: the glob makes the table's folder the base path
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files)
            .parquet(f"{sf_dir}/documents*.parquet"))


def tickets_from_documents(docs: DataFrame) -> DataFrame:
    """The fixture ticket mapping as a per-row projection (stream-safe)."""
    minutes = ((F.col("doc_id") * MIX) % TICKET_SPREAD_MINUTES).cast("int")
    as_of = F.lit(FIXTURE_AS_OF).cast("timestamp_ntz")
    return docs.select(
        F.col("doc_id").alias("id"), F.col("doc_id").alias("number"),
        F.split_part(F.col("text"), F.lit("\n"), F.lit(1)).alias("subject"), F.col("text").alias("preview"),
        F.lit("active").alias("status"), (F.col("doc_id") % N_MAILBOXES).alias("mailbox_id"),
        (as_of - F.make_dt_interval(F.lit(0), F.lit(0), minutes, F.lit(0))).alias("created_at"),
        F.lit(None).cast("timestamp_ntz").alias("closed_at"),
        F.when(F.col("doc_id") % 7 == 0, F.array(F.lit("Bug"), F.lit("urgent")))
        .when(F.col("doc_id") % 11 == 0, F.array(F.lit("vip"), F.lit("Escalation")))
        .otherwise(F.array().cast("array<string>")).alias("tags"),
        (F.col("doc_id") % 8).cast("int").alias("threads"),
        F.lit(None).cast("string").alias("customer_email"),
    )


def tagged_ticket_stream(docs: DataFrame, cfg: ThemesConfig) -> DataFrame:
    """Scrubbed, normalised and theme-tagged ticket signals, one row in -> one row out."""
    signals = nz.ticket_signals(nz.tickets_clean(tickets_from_documents(docs)))
    return th.tag_signals(signals, cfg).select("id", "source", "title", "created_at", "theme_idxs", "pii",
                                               nz.signal_quote().alias("quote"))


def run_to_table(stream: DataFrame, name: str, checkpoint: str):
    """Drain the available input into an in-memory table (tests / smoke runs)."""
    q = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint)
         .outputMode("append").start())
    q.processAllAvailable()
    q.stop()
    return stream.sparkSession.table(name)
