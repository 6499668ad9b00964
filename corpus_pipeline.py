"""Corpus pipeline: language ID, exact dedup, near dedup, source mixing, packing.

Each stage takes ``(spark, docs, sf_dir)``, calls one operator on all rows its
predecessor kept, and returns the columns of ``documents`` (the last: packed
pieces).  ``docs`` is a Parquet table, so row numbers of a scan are stable.

Defined results: a stage keeps repeated rows, null ids and extra columns as its
operator's module says; an empty table passes through as an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from signalmesh.llm.common import table, written
from signalmesh.llm.exact_dedup import drop_copies
from signalmesh.llm.lang_id import keep_identified
from signalmesh.llm.mixing import repeat_rows
from signalmesh.llm.near_dedup import drop_near_copies
from signalmesh.llm.packing import harmonic_pack


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts whose language the model tells; rejected: no letters at all, or no language with a score of ``lang_id.AT_LEAST``."""
    return keep_identified(docs)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near-duplicates, the row with the smallest doc_id."""
    return drop_near_copies(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix of sources takes them."""
    return repeat_rows(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, with their ids."""
    return harmonic_pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("packing", packing)]

#: The language model has no SQL form; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
