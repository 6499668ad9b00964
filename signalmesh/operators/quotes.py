"""Representative quotes and title lists: J3, W4, W5, W6, W7.

Per-theme windows here are ``row_number() <= k`` with small k, which Catalyst
turns into a ``WindowGroupLimit`` ahead of the shuffle: a theme holding a
third of all points ships at most k rows per map task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmesh.operators.normalize import first_message, signal_quote

# Caps and the sentinel quote.
MAX_QUOTES = 3
MAX_TITLES = 50
NO_QUOTE = "No direct customer quote available"


def with_quote(signals: DataFrame) -> DataFrame:
    """Signals with their ready ``quote`` (X17), so that later joins carry no text but it."""
    if "quote" in signals.columns:
        return signals
    message = "__message"  # a column of its own: collapsed once, not at every mention
    return signals.withColumn(message, first_message()).withColumn("quote", signal_quote(F.col(message))).drop(message)


def quote_lookup(signals: DataFrame) -> DataFrame:
    """J3 lookup side: per prefixed id the quote of the *last* record (by ord)."""
    q = with_quote(signals).select("id", "ord", F.struct("quote").alias("q"))
    return q.groupBy("id").agg(F.max_by("q", "ord").alias("q")).select("id", F.col("q.quote").alias("quote"))


def theme_quotes(points: DataFrame, signals: DataFrame, key: str = "theme_idx", k: int = MAX_QUOTES) -> DataFrame:
    """First ``k`` usable quotes per theme in point order -> ``(key, quote_rank, quote)``.

    Ids, places and quotes of at most 200 characters are all that is joined;
    themes without a usable quote get the sentinel.
    """
    w = Window.partitionBy(key).orderBy("ord")
    usable = quote_lookup(signals).filter(F.col("quote").isNotNull())
    got = (points.select(key, "id", "ord").join(usable, "id").select(key, "ord", "quote")
           .withColumn("quote_rank", F.row_number().over(w)).filter(F.col("quote_rank") <= k)
           .select(key, F.col("quote_rank").cast("bigint"), "quote"))
    missing = points.select(key).distinct().join(got.select(key).distinct(), key, "left_anti").select(
        key, F.lit(1).cast("bigint").alias("quote_rank"), F.lit(NO_QUOTE).alias("quote"))
    return got.unionByName(missing)


def theme_titles(points: DataFrame, key: str = "theme_idx", k: int = MAX_TITLES) -> DataFrame:
    """First ``k`` titles per theme -> ``(key, title_rank, title)``."""
    w = Window.partitionBy(key).orderBy("ord")
    return (points.withColumn("title_rank", F.row_number().over(w)).filter(F.col("title_rank") <= k)
            .select(key, F.col("title_rank").cast("bigint"), "title"))


def title_totals(points: DataFrame, key: str = "theme_idx", k: int = MAX_TITLES) -> DataFrame:
    """W5 totals: ``(key, data_points_total, data_point_titles_truncated)``; the
    flag is null unless the list was cut (the source omits it otherwise)."""
    return points.groupBy(key).agg(F.count(F.lit(1)).cast("bigint").alias("data_points_total")).withColumn(
        "data_point_titles_truncated", F.when(F.col("data_points_total") > k, F.lit(True)))


def emerging_top(emerging: DataFrame, k: int | None) -> DataFrame:
    """First ``k`` emerging themes in claim order (all when ``k`` is None)."""
    ordered = emerging.orderBy("rk")
    return ordered if k is None else ordered.limit(k)


def emerging_samples(emerging_points: DataFrame, k: int) -> DataFrame:
    """First ``k`` member titles of every emerging theme, in signal order."""
    w = Window.partitionBy("ngram").orderBy("ord")
    return (emerging_points.withColumn("sample_rank", F.row_number().over(w)).filter(F.col("sample_rank") <= k)
            .select("ngram", F.col("sample_rank").cast("bigint"), "title"))
