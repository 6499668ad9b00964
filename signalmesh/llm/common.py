"""Helpers shared by the training-data operators.

Every operator selects the columns it needs under internal names first, so
extra input columns (whatever their names) never reach it; null texts count as
empty unless an operator says otherwise.
"""

from __future__ import annotations

import gc
import string
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.session import materialize, ship  # noqa: F401

RID = "__rid"
#: The bytes that separate words: space and tab to carriage return.
SPACE = r"\x20\x09-\x0D"
ASCII_UPPER, ASCII_LOWER = string.ascii_uppercase, string.ascii_lowercase


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **more: str) -> DataFrame:
    """``doc_id`` (long) and ``text`` (null as empty), and more columns by keyword."""
    ship(docs.sparkSession)
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                       *[F.col(src).alias(name) for name, src in more.items()])


def with_rid(docs: DataFrame) -> DataFrame:
    """Number the rows for one job (repeated rows stay apart).

    A later scan may be split otherwise and number them anew; where rows are
    met again, they are :func:`numbered` once.
    """
    return docs.withColumn(RID, F.monotonically_increasing_id())


def numbered(docs: DataFrame) -> DataFrame:
    """The rows with their numbers, written, so that every later job reads the same ones whatever the cluster looks like then."""
    return written(with_rid(docs), "numbered")


def identified(docs: DataFrame, doc_id: str, text: str, has_rid: bool) -> DataFrame:
    """Row numbers and :func:`texts` of a table, which :func:`numbered` has made or which is numbered here."""
    return texts(docs, doc_id, text, **{RID: RID}) if has_rid else numbered(texts(docs, doc_id, text))


def keep_rows(docs: DataFrame, rids: DataFrame) -> DataFrame:
    """The rows of :func:`numbered` ``docs`` whose number is in ``rids``."""
    return docs.join(rids.select(RID), RID, "left_semi").drop(RID)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared checkpoint folder and read back: lineage is cut there."""
    return materialize(df, name)


def ascii_lower(c: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_LOWER)


def flushed(rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000, weigh=None, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Row tuples as record batches of at most ``size`` rows (or about ``most`` units of ``weigh``)."""
    part: list[tuple] = []
    heavy = 0
    for row in rows:
        part.append(row)
        heavy += weigh(row) if weigh else 0
        if len(part) >= size or heavy >= most:
            yield _batch(part, schema)
            part, heavy = [], 0
    if part:
        yield _batch(part, schema)


def given_back(batches: Iterable[pa.RecordBatch], *caches: dict) -> Iterator[pa.RecordBatch]:
    """A task's batches; when it ends, the worker's caches are emptied and free memory returned.

    A Python worker serves the tasks of many stages: what one of them keeps counts in all later ones.
    """
    try:
        yield from batches
    finally:
        for cache in caches:
            cache.clear()
        gc.collect()  # also the caches of models that hold each other
        pa.default_memory_pool().release_unused()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows))
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(cols, schema)], schema=schema)


def documents(batches: Iterable[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples of the named columns, a slice at a time so that long texts are not all decoded at once."""
    for batch in batches:
        at = [batch.schema.get_field_index(n) for n in names]
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            yield from zip(*[part.column(i).to_pylist() for i in at])
