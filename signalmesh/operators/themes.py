"""Theme matching and scoring: J1, J2, A1-A7, A10, W1.

J1 is compiled from the (driver-side, config-sized) theme catalogue into one
array of per-theme predicates, then exploded: a narrow stage with no shuffle.
A1-A6 is one partial+final hash aggregate keyed by theme; the global maxima
are taken over that <= #themes-row result and cross-joined as a broadcast
single row.  W1 sorts the same tiny table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from signalmesh.config import ThemesConfig
from signalmesh.functions.scoring import recency_boost, round2, tag_boost, thread_score
from signalmesh.functions.text import keyword_match
from signalmesh.params import Params
from signalmesh.operators.keyword_index import keyword_index, match_by_index
from signalmesh.session import attach_row, materialize


#: A point's severity (at most 110) to 15 places.
EXACT = "decimal(18,15)"


def matched_theme_array(cfg: ThemesConfig, text: str = "text"):
    """Indices of every theme whose keywords hit ``text`` (config order)."""
    if not cfg.themes:
        return F.array().cast("array<int>")
    arr = F.array(*[F.when(keyword_match(F.col(text), t.keywords), F.lit(i)) for i, t in enumerate(cfg.themes)])
    return F.filter(arr, lambda x: x.isNotNull())


def tag_signals(signals: DataFrame, cfg: ThemesConfig) -> DataFrame:
    """J1 predicate side: ``theme_idxs`` = matching theme indices per signal.

    The lower-cased text is built, matched and dropped in one projection; it
    is re-derived only for the (few) signals that reach the n-gram stage.
    """
    from signalmesh.operators.normalize import signal_text

    if "text" in signals.columns:
        return signals.withColumn("theme_idxs", matched_theme_array(cfg))
    return (signals.withColumn("text", signal_text()).withColumn("theme_idxs", matched_theme_array(cfg))
            .drop("text"))


def tag_signals_by_index(signals: DataFrame, themes: DataFrame) -> DataFrame:
    """J1 for a catalogue of any size: :func:`tag_signals` by the keyword index of ``themes`` (``theme_idx, keywords``).

    A signal is told by its id, place and text; ``theme_idxs`` is sorted.
    """
    from signalmesh.operators.normalize import with_text

    index = materialize(keyword_index(themes.select("theme_idx", F.explode("keywords").alias("keyword"))), "keyword-index")
    keyed = with_text(signals).withColumn("__h", F.xxhash64("text"))
    hits = match_by_index(keyed, index, ["id", "ord", "__h"])
    idxs = hits.groupBy("id", "ord", "__h").agg(F.sort_array(F.collect_list("theme")).alias("theme_idxs"))
    return (keyed.join(idxs, ["id", "ord", "__h"], "left")
            .withColumn("theme_idxs", F.coalesce("theme_idxs", F.array().cast("array<int>"))).select(*signals.columns, "theme_idxs"))


POINT_COLUMNS = ("id", "source", "title", "created_at", "tags", "thread_count", "votes", "comments_count",
                 "portal", "ord")


def theme_points(tagged: DataFrame) -> DataFrame:
    """One row per (theme, matching signal); many-to-many."""
    return tagged.select(*POINT_COLUMNS, F.explode("theme_idxs").alias("theme_idx"))


def unmatched_signals(tagged: DataFrame) -> DataFrame:
    """Signals whose id matched no theme -- by id, not by row: a row with no
    hit still counts as matched when another row with its id hit.

    Only ids that have rows of both kinds need the anti join (an aggregate of ids
    and flags finds them); of an ordinary feed these are none or few.
    """
    hit = F.size("theme_idxs") > 0
    both = (tagged.select("id", hit.alias("hit")).groupBy("id").agg(F.max("hit").alias("any"), F.min("hit").alias("all"))
            .filter(F.col("any") & ~F.col("all")).select("id"))
    return tagged.filter(~hit).join(both, "id", "left_anti")


def theme_aggregates(points: DataFrame, p: Params) -> DataFrame:
    """A1 + the raw sums behind A4/A5, keyed by ``theme_idx``."""
    w = p.weights
    as_of = F.lit(p.as_of).cast("timestamp_ntz")
    reactive = F.col("source") == "REACTIVE"
    proactive = F.col("source") == "PROACTIVE"
    point_sev = thread_score(F.col("thread_count"), w) + recency_boost(F.col("created_at"), as_of, w) + tag_boost(
        F.col("tags"))
    return points.groupBy("theme_idx").agg(
        F.count(F.lit(1)).alias("points"),
        F.count(F.when(reactive, 1)).alias("reactive_count"),
        F.count(F.when(proactive, 1)).alias("proactive_count"),
        # a sum of decimals is the same in any order of tasks; a double's last digits are not
        F.sum(F.when(reactive, point_sev).cast(EXACT)).cast("double").alias("sev_sum"),
        F.sum(F.when(proactive, F.coalesce(F.col("votes"), F.lit(0)))).alias("votes_sum"),
        F.sum(F.when(proactive, F.coalesce(F.col("comments_count"), F.lit(0)))).alias("comments_sum"),
    )


def theme_scores(points: DataFrame, themes: DataFrame, p: Params) -> DataFrame:
    """A2-A6 on top of A1: one row per theme with >= 1 point.

    Columns: theme_idx, theme_id, label, category, reactive_count,
    proactive_count, points, convergent, frequency_score, severity_score,
    vote_momentum_score, priority_score (rounded) and priority_raw.
    """
    w = p.weights
    agg = theme_aggregates(points, p).withColumn(
        "momentum_raw",
        F.coalesce(F.col("votes_sum"), F.lit(0)).cast("double") * F.lit(w.vote_share)
        + F.coalesce(F.col("comments_sum"), F.lit(0)).cast("double") * F.lit(w.comment_share),
    )
    maxes = agg.agg(F.max("points").alias("max_points"), F.max("momentum_raw").alias("max_momentum"))
    maxes = maxes.select(
        F.greatest(F.coalesce(F.col("max_points").cast("double"), F.lit(0.0)), F.lit(1.0)).alias("max_points"),
        F.greatest(F.coalesce(F.col("max_momentum"), F.lit(0.0)), F.lit(1.0)).alias("max_momentum"),
    )
    s = attach_row(agg, maxes).join(F.broadcast(themes.drop("keywords")), "theme_idx")
    convergent = (F.col("reactive_count") > 0) & (F.col("proactive_count") > 0)
    freq = F.col("points").cast("double") / F.col("max_points") * F.lit(100.0)
    sev = F.when(F.col("reactive_count") > 0,
                 F.least(F.col("sev_sum") / F.col("reactive_count").cast("double"), F.lit(w.severity_cap))
                 ).otherwise(F.lit(0.0))
    votes = F.col("momentum_raw") / F.col("max_momentum") * F.lit(100.0)
    s = s.select(
        "theme_idx", "theme_id", "label", "category",
        F.col("reactive_count").cast("bigint").alias("reactive_count"),
        F.col("proactive_count").cast("bigint").alias("proactive_count"),
        F.col("points").cast("bigint").alias("points"),
        convergent.alias("convergent"),
        freq.alias("f"), sev.alias("s"), votes.alias("v"),
    )
    boost = F.when(F.col("convergent"), F.lit(w.convergence_boost)).otherwise(F.lit(1.0))
    pr = (F.col("f") * F.lit(w.frequency) + F.col("s") * F.lit(w.severity) + F.col("v") * F.lit(w.votes)) * boost
    return s.select(
        "theme_idx", "theme_id", "label", "category", "reactive_count", "proactive_count", "points", "convergent",
        round2(F.col("f")).alias("frequency_score"),
        round2(F.col("s")).alias("severity_score"),
        round2(F.col("v")).alias("vote_momentum_score"),
        round2(pr).alias("priority_score"),
    )


def theme_ranking(scores: DataFrame) -> DataFrame:
    """Rank by rounded priority desc, ties in config order.

    ``scores`` has at most one row per configured theme, so an unpartitioned
    window over it is a single small task by construction.
    """
    w = Window.orderBy(F.col("priority_score").desc(), F.col("theme_idx").asc())
    return scores.withColumn("rank", F.row_number().over(w).cast("bigint"))


def run_summary(signals: DataFrame, scores: DataFrame, unmatched: DataFrame, cfg: ThemesConfig) -> DataFrame:
    """One row of run counts -- a single aggregate over the three inputs."""
    parts = (signals.select(F.lit("signal").alias("kind"), "source", F.lit(False).alias("convergent"))
             .unionByName(scores.select(F.lit("theme").alias("kind"), F.lit(None).cast("string").alias("source"),
                                        "convergent"))
             .unionByName(unmatched.select(F.lit("unmatched").alias("kind"), "source",
                                           F.lit(False).alias("convergent"))))
    k = F.col("kind")
    return parts.agg(
        F.lit(cfg.version).cast("bigint").alias("config_version"),
        F.lit(len(cfg.themes)).cast("bigint").alias("known_themes_count"),
        F.count(F.when(k == "signal", 1)).cast("bigint").alias("total_data_points"),
        F.count(F.when((k == "signal") & (F.col("source") == "REACTIVE"), 1)).cast("bigint").alias("reactive_count"),
        F.count(F.when((k == "signal") & (F.col("source") == "PROACTIVE"), 1)).cast("bigint").alias("proactive_count"),
        F.count(F.when(k == "theme", 1)).cast("bigint").alias("themes_detected"),
        F.count(F.when((k == "theme") & F.col("convergent"), 1)).cast("bigint").alias("convergent_themes"),
        F.count(F.when(k == "unmatched", 1)).cast("bigint").alias("unmatched_count"),
    )
