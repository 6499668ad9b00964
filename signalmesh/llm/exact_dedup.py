"""Operator 9: exact deduplication that no hot text can overload.

Texts are equal when identical after lower-casing A-Z.  Copies meet in three
stages, each of which groups by the whole normalised text beside its digest,
so that a digest alone never decides: (1) every task merges its own copies
(map-side aggregation), (2) copies of one salt meet, (3) the salts' winners
meet.  A text that fills a third of the table so reaches any task of stage 2
at most once a map task, and stage 3 once a salt.  A winner is a doc_id and a
count, not a list.

Rows are then matched to winners by digest, without texts, in a join of two
written tables, where Spark can split a hot digest.  Should two texts share a
digest, the rows of that digest alone are matched by text.

Defined results: null text counts as empty; empty texts are one group; equal
doc_ids of one group all count and are all ``kept`` (they are one document;
:func:`drop_copies` leaves one row); null doc_ids lose to others, and a group
of null doc_ids has a null ``keep_id``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import RID, documents, flushed, identified, keep_rows, numbered, table, texts, with_rid, written
from signalmesh.session import only_result

SALTS = 16

DIGESTS = pa.schema([(RID, pa.int64()), ("doc_id", pa.int64()), ("sha", pa.binary())])
TEXTS = pa.schema([("sha", pa.binary()), ("salt", pa.int32()), ("norm", pa.binary()), ("doc_id", pa.int64())])


def _rows(batches: Iterable[pa.RecordBatch], salts: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    def rows():
        for rid, doc_id, text in documents(batches, RID, "doc_id", "text"):
            norm = text.encode().lower()  # on bytes: A-Z only
            sha = hashlib.sha256(norm).digest()
            yield (sha, rid % salts, norm, doc_id) if with_text else (rid, doc_id, sha)

    yield from flushed(rows(), TEXTS if with_text else DIGESTS, weigh=lambda r: len(r[2]))


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", salts: int = SALTS,
                 digest: Column | None = None, has_rid: bool = False) -> DataFrame:
    """One row per input row: row number, ``doc_id, keep_id, group_size, kept, text_sha256``.

    ``digest`` may be a shorter function of ``sha`` (tests make collisions with it); ``has_rid``: the rows are numbered.
    """
    digest = F.col("sha") if digest is None else digest
    rows = identified(docs, doc_id, text, True) if has_rid else with_rid(texts(docs, doc_id, text))
    ids = written(rows.mapInArrow(lambda b: _rows(b, salts, False), f"{RID} long, doc_id long, sha binary")
                  .withColumn("digest", digest), "exact-ids")

    def merged(source: DataFrame, *by: str) -> DataFrame:
        return source.groupBy("digest", *by, "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n"))

    contents = (rows.mapInArrow(lambda b: _rows(b, salts, True), "sha binary, salt int, norm binary, doc_id long")
                .select(digest.alias("digest"), "salt", "norm", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n")))
    by_salt = merged(contents, "salt")
    # dealt by digest: the grouping by text and the count of texts a digest stands for need no second exchange
    groups = merged(by_salt.repartition("digest"))
    winners = written(groups.groupBy("digest").agg(F.count("*").alias("variants"), F.max("keep_id").alias("keep_id"),
                                                   F.max("n").alias("n")), "exact-winners")
    out = ids.join(winners.filter("variants = 1").drop("variants"), "digest")
    shared = winners.filter("variants > 1").select("digest")
    if not shared.isEmpty():
        out = out.unionByName(_by_text(rows, ids, shared, salts, digest))
    return out.select(RID, "doc_id", "keep_id", F.col("n").alias("group_size"),
                      F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def _by_text(rows: DataFrame, ids: DataFrame, shared: DataFrame, salts: int, digest: Column) -> DataFrame:
    """The exact way for digests that stand for several texts: their rows meet their winners by text."""
    texts_ = (rows.mapInArrow(_keyed_texts, f"{RID} long, sha binary, norm binary, doc_id long")
              .withColumn("digest", digest).join(shared, "digest", "left_semi"))
    winners = (texts_.groupBy("digest", "norm", F.pmod(RID, F.lit(salts)).alias("salt"))
               .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("n"))
               .groupBy("digest", "norm").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("n")))
    return texts_.join(winners, ["digest", "norm"]).select(*ids.columns, "keep_id", "n")


def _keyed_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([(RID, pa.int64()), ("sha", pa.binary()), ("norm", pa.binary()), ("doc_id", pa.int64())])

    def rows():
        for rid, doc_id, text in documents(batches, RID, "doc_id", "text"):
            norm = text.encode().lower()
            yield rid, hashlib.sha256(norm).digest(), norm, doc_id

    yield from flushed(rows(), schema, weigh=lambda r: len(r[2]))


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of equal texts, one row with the largest doc_id."""
    docs = numbered(docs)
    kept = only_result(docs.sparkSession, lambda: exact_groups(docs, has_rid=True).filter("kept").groupBy("text_sha256").agg(F.min(RID).alias(RID)), "exact-kept")
    return keep_rows(docs, kept)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts of all ``documents``."""
    return exact_groups(table(spark, sf_dir, "documents")).drop(RID)


#: The same in DuckDB.
ORACLE_SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
