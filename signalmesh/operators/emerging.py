"""Emerging themes among unmatched signals: X9/X10 -> A8, W9, A9.

The source walks n-grams one by one in rank order (document frequency desc,
ties by first appearance) and lets each claim the still-unclaimed signals it
occurs in, provided at least ``min_frequency`` remain.  That loop is
inherently sequential, so here it runs as parallel rounds (the parallel
greedy-MIS argument of Blelloch, Fineman and Shun, SPAA 2012):

1. live postings = (n-gram, signal) of undecided n-grams and unclaimed signals;
2. per signal, ``m`` = smallest rank among its undecided n-grams  (window
   partitioned by signal -- a signal's postings are bounded by its own text);
3. per n-gram (hash aggregate with map-side partials, so a hot n-gram is
   combined before the shuffle): live count and "is it ``m`` at every live
   signal"; fewer than ``min_frequency`` live signals -> rejected for good
   (counts only fall), minimum everywhere -> accepted, claiming its live
   signals with frequency = live count;
4. repeat until no n-gram is undecided.

Every round the globally smallest undecided n-gram is decided, and an
accepted n-gram shares no live signal with any smaller undecided one, so the
result equals the sequential walk.  Signals and n-grams are first numbered in
their order, so that a posting is two numbers and ranks compare as numbers.
A round is one job of three exchanges; it writes the postings it accepts beside
those still undecided.  The former are final and never read by a later round,
rejected ones and those of claimed signals are not written again, so what a
round reads and writes falls from round to round.
"""

from __future__ import annotations

import logging
import uuid

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from signalmesh.config import ThemesConfig
from signalmesh.functions.text import ngrams, tokens
from signalmesh.operators.normalize import with_text
from signalmesh.session import discard, materialize, remove, tables_folder

log = logging.getLogger(__name__)

UNDECIDED, ACCEPTED, REJECTED = 0, 1, -1


def _keyed(unmatched: DataFrame) -> DataFrame:
    """Signals with their text; ``ord`` gets a hash of it, so that rows of one ticket
    with different texts stay apart (rows alike share all n-grams and fates)."""
    return with_text(unmatched).withColumn("ord", F.col("ord").withField("h", F.xxhash64("text")))


def ngram_occurrences(unmatched: DataFrame, stop_words) -> DataFrame:
    """(ord, pos, ngram): each signal's distinct n-grams with first position.

    ``array_distinct`` keeps first occurrences in order, so ``pos`` orders the
    n-grams of one signal exactly as first appearance does.
    """
    # tokens first as a column: a lambda body re-evaluates an inlined expression
    # per element, so ngrams() must reference an attribute, not the tokenizer.
    toks = _keyed(unmatched).select("ord", tokens(F.col("text"), stop_words).alias("toks"))
    grams = F.array_distinct(ngrams(F.col("toks")))
    return toks.select("ord", F.posexplode(grams).alias("pos", "ngram"))


def ngram_stats(occ: DataFrame, min_frequency: int) -> DataFrame:
    """A8 + W9: per n-gram document frequency and first appearance, df >= min.

    ``rk`` is the rank key: smaller = earlier in the greedy walk.
    """
    return ranked(frequent(occ, min_frequency))


def frequent(occ: DataFrame, min_frequency: int) -> DataFrame:
    """The occurrences of n-grams with df >= min, with ``df``.

    Counts alone come first (a hash aggregate without structs); they are
    written, so that the join has two plain sides and a hot n-gram can be split.
    """
    df = materialize(occ.groupBy("ngram").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") >= F.lit(min_frequency)),
                     "ngram-df")
    return occ.join(df, "ngram")


def ranked(kept: DataFrame) -> DataFrame:
    g = kept.groupBy("ngram", "df").agg(F.min(F.struct("ord", "pos")).alias("first_seen"))
    return g.withColumn("rk", F.struct((-F.col("df")).alias("neg_df"), F.col("first_seen").alias("first_seen")))


def _undecided(state: DataFrame) -> DataFrame:
    """The undecided postings of unclaimed signals, each with its signal's smallest rank ``m``."""
    by_signal = Window.partitionBy("ord")
    return (state.withColumn("claimed", F.max(F.col("st") == ACCEPTED).over(by_signal))
            .withColumn("m", F.min(F.when(F.col("st") == UNDECIDED, F.col("rk"))).over(by_signal))
            .filter((F.col("st") == UNDECIDED) & ~F.col("claimed")))


def claim_round(state: DataFrame, min_frequency: int) -> DataFrame:
    """One round on ``(rk, ord, st, cnt)``: the postings it accepts and those it leaves undecided.

    ``state`` is the last round's result; the postings accepted there claim their signals here.
    """
    s = _undecided(state)
    decision = s.groupBy("rk").agg(
        F.count(F.lit(1)).alias("cnt"),
        F.min((F.col("rk") == F.col("m")).cast("int")).alias("ok"),
    ).select(
        "rk", "cnt",
        F.when(F.col("cnt") < F.lit(min_frequency), F.lit(REJECTED))
        .when(F.col("ok") == 1, F.lit(ACCEPTED)).otherwise(F.lit(UNDECIDED)).alias("st"),
    ).filter(F.col("st") != REJECTED)
    return s.select("rk", "ord").join(decision, "rk").select("rk", "ord", "cnt", "st")


def greedy_claim(postings: DataFrame, min_frequency: int, max_rounds: int = 100_000) -> DataFrame:
    """A9 core on postings ``(rk, ord)`` (an n-gram's rank, a signal) -> accepted ``(rk, ord, cnt)``.

    A round's table has a folder of accepted postings, which are part of the
    result, and one of undecided ones, deleted once the next round is written.
    The undecided count rides along the write as an observed metric, so
    termination costs no extra job.
    """
    spark = postings.sparkSession
    base = f"{tables_folder(spark)}/claims-{uuid.uuid4().hex}"
    state = postings.select("rk", "ord", F.lit(0).cast("bigint").alias("cnt"), F.lit(UNDECIDED).alias("st"))
    schema, rounds = state.schema, []
    while len(rounds) < max_rounds:
        obs, path = Observation(f"claims-{uuid.uuid4().hex}"), f"{base}/round={len(rounds)}"
        (claim_round(state, min_frequency).observe(obs, F.count(F.when(F.col("st") == UNDECIDED, 1)).alias("undecided"))
         .write.partitionBy("st").parquet(path))
        if rounds:
            remove(spark, f"{rounds[-1]}/st={UNDECIDED}")
        rounds.append(path)
        undecided = obs.get["undecided"]
        log.debug("round %d: %d undecided postings", len(rounds), undecided)
        if undecided == 0:
            return spark.read.schema(schema).parquet(base).filter(F.col("st") == ACCEPTED).select("rk", "ord", "cnt")
        state = spark.read.schema(schema).parquet(path)
    raise RuntimeError("emerging-theme rounds did not converge")


def _in_order(df: DataFrame, number: str, *order) -> DataFrame:
    """The rows of a written table written in their order, with a number that rises with it: a range sort, no single task."""
    out = materialize(df.orderBy(*order).withColumn(number, F.monotonically_increasing_id()), number)
    discard(df)
    return out


def emerging_themes(unmatched: DataFrame, cfg: ThemesConfig) -> tuple[DataFrame, DataFrame]:
    """``emerging(ngram, frequency, rk)`` and ``emerging_points(ngram, rk,
    id, source, title, ord)``; order both by ``rk`` (claim order) and ``ord``."""
    minf = cfg.emerging_theme_min_frequency
    # tokenized once and written, as the sort samples its input first
    toks = materialize(_keyed(unmatched).select("ord", "id", "source", "title", tokens(F.col("text"), cfg.stop_words).alias("toks")),
                       "emerging-tokens")
    signals = _in_order(toks, "signal", "ord")
    occ = signals.select("signal", F.posexplode(F.array_distinct(ngrams(F.col("toks")))).alias("pos", "ngram"))
    counted = materialize(
        occ.groupBy("ngram").agg(F.count(F.lit(1)).alias("df"), F.min("signal").alias("first"), F.min_by("pos", "signal").alias("pos"))
        .filter(F.col("df") >= F.lit(minf)), "ngram-df")
    names = _in_order(counted, "rank", F.desc("df"), "first", "pos")
    won = greedy_claim(occ.join(names.select("ngram", "rank"), "ngram").select(F.col("rank").alias("rk"), F.col("signal").alias("ord")), minf)
    first = signals.select(F.col("signal").alias("first"), F.struct("ord").alias("seen"))
    seen = F.struct(F.col("seen.ord").alias("ord"), F.col("pos").alias("pos"))
    key = F.struct((-F.col("df")).alias("neg_df"), seen.alias("first_seen")).alias("rk")
    taken = won.groupBy(F.col("rk").alias("rank")).agg(F.max("cnt").cast("bigint").alias("frequency"))
    named = materialize(names.join(taken, "rank").join(first, "first").select("rank", "ngram", "frequency", key), "emerging-names")
    discard(names)
    pts = (won.select(F.col("rk").alias("rank"), F.col("ord").alias("signal")).join(named.select("rank", "ngram", "rk"), "rank")
           .join(signals.select("signal", "id", "source", "title", F.col("ord").dropFields("h").alias("ord")), "signal"))
    return named.select("ngram", "rk", "frequency"), pts.select("ngram", "rk", "ord", "id", "source", "title")
