"""The analysis job behind ``synthesize_feedback`` and ``product_plan``.

Dataflow (one Spark plan per output table, sharing one materialised signals
table):

  tickets --F1/F3--> F6 scrub --F8--+
                                    +--U1--> signals (written once)
  posts --F4--W2/W3--> F7 scrub -F9-+            |
                                   J1 explode -> theme_points -> A1..A6 -> W1
                                   J2 left-anti -> A8 -> A9 rounds -> emerging
                                   J3/W4/W5 quotes and titles
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.config import ThemesConfig, themes_frame
from signalmesh.operators import emerging as em
from signalmesh.operators import normalize as nz
from signalmesh.operators import quotes as qt
from signalmesh.operators import selection as sel
from signalmesh.operators import themes as th
from signalmesh.params import Params
from signalmesh.session import discard, materialize
from signalmesh.sources import fixtures
from signalmesh.sources.landed import Landed


@dataclass
class Feeds:
    tickets: DataFrame     # raw tickets
    posts: DataFrame       # raw posts (feed_seq = feed order within a portal)
    mailboxes: DataFrame
    comments: DataFrame | None = None


def fixture_feeds(spark: SparkSession, sf_dir: str) -> Feeds:
    return Feeds(fixtures.tickets(spark, sf_dir), fixtures.posts(spark, sf_dir), fixtures.mailboxes(spark, sf_dir),
                 fixtures.comments(spark, sf_dir))


def landed_feeds(landed: Landed) -> Feeds:
    """Feeds of a run on landed pages; portals keep their configured order."""
    place = landed.portals.select(F.col("name").alias("portal"), F.col("pos").alias("portal_pos"))
    return Feeds(landed.tickets, landed.posts.join(place, "portal", "left"), landed.mailboxes, landed.comments)


def selected_tickets(feeds: Feeds, p: Params) -> DataFrame:
    return sel.filter_mailbox(sel.tickets_in_window(feeds.tickets, p), feeds.mailboxes, p)


def clean_tickets(feeds: Feeds, p: Params) -> DataFrame:
    return nz.tickets_clean(selected_tickets(feeds, p))


def clean_requests(feeds: Feeds, p: Params) -> DataFrame:
    """Analysis never attaches comments (the source passes include_comments=false)."""
    return nz.requests_clean(sel.selected_posts(feeds.posts, p))


@dataclass
class Analysis:
    params: Params
    cfg: ThemesConfig
    tickets: DataFrame       # F6 output
    requests: DataFrame      # F7 output
    signals: DataFrame       # U1, materialised
    points: DataFrame        # J1/A10 long table
    scores: DataFrame        # A1-A6 + W1 rank
    unmatched: DataFrame     # J2
    themes: DataFrame        # dimension

    _emerging: tuple[DataFrame, DataFrame] | None = None
    _small: dict | None = None

    def _once(self, name: str, build) -> DataFrame:
        """Config-bounded results (per theme / one row) are computed once and cached."""
        if self._small is None:
            self._small = {}
        if name not in self._small:
            self._small[name] = materialize(build(), name)
        return self._small[name]

    @property
    def emerging(self) -> DataFrame:
        return self._emerging_pair()[0]

    @property
    def emerging_points(self) -> DataFrame:
        return self._emerging_pair()[1]

    def _emerging_pair(self) -> tuple[DataFrame, DataFrame]:
        if self._emerging is None:
            e, pts = em.emerging_themes(self.unmatched, self.cfg)
            self._emerging = (materialize(e, "emerging"), materialize(pts, "emerging_points"))
            for made in (e, pts):  # the rounds' tables; the results are tables of their own
                discard(made)
        return self._emerging

    def summary(self) -> DataFrame:
        return self._once("summary", lambda: th.run_summary(self.signals, self.scores, self.unmatched, self.cfg))

    def pii_categories(self) -> DataFrame:
        return nz.pii_run_categories(self.signals)

    def data_sources(self) -> DataFrame:
        """Feeds that contributed at least one signal (neutral names)."""
        return self._once("data_sources", lambda: self.signals.groupBy("source").agg(
            F.count(F.lit(1)).alias("n")).select(
            F.when(F.col("source") == "REACTIVE", "support_tickets").otherwise("feature_votes").alias("data_source")))

    def quotes(self) -> DataFrame:
        return self._once("quotes", lambda: qt.theme_quotes(self.points, self.signals))

    def titles(self) -> DataFrame:
        return qt.theme_titles(self.points)

    def unpersist(self) -> None:
        """Delete the tables written for this analysis; its frames cannot be read afterwards."""
        for df in (self.signals, self.scores, *(self._small or {}).values(), *(self._emerging or ())):
            discard(df)


def analyze(feeds: Feeds, cfg: ThemesConfig, p: Params, persist: bool = True) -> Analysis:
    spark = feeds.tickets.sparkSession
    tickets = clean_tickets(feeds, p)
    requests = clean_requests(feeds, p)
    # J1 predicates are evaluated once, while the signals are built and cached;
    # every consumer (A1, J2, J3, W4, W5, A8) reads the cached table.
    signals = qt.with_quote(th.tag_signals(nz.all_signals(nz.ticket_signals(tickets), nz.request_signals(requests)), cfg))
    if persist:
        # written once to the reliable checkpoint folder: downstream plans are
        # shallow file scans and an executor loss never re-runs the redaction
        signals = materialize(signals, "signals")
    points = th.theme_points(signals)
    themes = themes_frame(spark, cfg)
    scores = th.theme_ranking(th.theme_scores(points, themes, p))
    if persist:
        scores = materialize(scores, "scores")  # <= one row per configured theme
    unmatched = th.unmatched_signals(signals)
    return Analysis(p, cfg, tickets, requests, signals, points, scores, unmatched, themes)
