"""End-to-end jobs and sinks: synthesize_feedback (X18/S9), product_plan (W8,
S10, F13), feature_requests, list_sources (S8), pii_audit.

Per-theme arrays (quotes <= 3, titles <= 50, samples <= 3) are built only
after their caps, from tables with at most one row per configured theme, so
every ``collect_list`` here is bounded by configuration, never by data size.
Unbounded member lists stay long tables and are written in parallel.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmesh.functions import pii as px
from signalmesh.functions import scoring as sc
from signalmesh.operators import normalize as nz
from signalmesh.operators import quotes as qt
from signalmesh.operators import selection as sel
from signalmesh.params import Params
from signalmesh.session import attach_row
from signalmesh.sources import fixtures as fx

# Methodology version and KPI notes of the plan (the resource
# name is this library's own).
METHODOLOGY_VERSION = "2.1"
METHODOLOGY_RESOURCE = "signalmesh://methodology"
KPI_NOTE_GIVEN = ("Business metrics provided below. Use the methodology at signalmesh://methodology "
                  "to determine how these metrics should adjust the priority ranking above.")
KPI_NOTE_NONE = ("No business metrics provided. Priorities are based on customer signals only. "
                 "For stronger prioritization, provide churn data, traffic trends, or revenue "
                 "metrics via the kpi_context parameter.")

SEP = "|"


def _ranked_join(df: DataFrame, key: str, rank: str, value: str, out: str) -> DataFrame:
    """Per key, ``value``s joined with ``|`` in ``rank`` order (bounded lists only)."""
    return df.groupBy(key).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, value))), lambda s: s[value]), SEP)
        .alias(out))


def themes_view(a, level: str) -> DataFrame:
    """The per-theme projection of a detail level (summary / standard).

    ``full`` is the raw analysis: :func:`write_synthesis` writes its long tables.
    """
    s = a.scores
    quotes = _ranked_join(a.quotes(), "theme_idx", "quote_rank", "quote", "representative_quotes")
    base = s.join(quotes, "theme_idx", "left").select(
        "theme_idx", "rank", "theme_id", "label", "category", "priority_score", "convergent",
        sc.signal_type(F.col("convergent"), F.col("reactive_count")).alias("signal_type"),
        "reactive_count", "proactive_count",
        sc.evidence_summary(F.col("reactive_count"), F.col("proactive_count"), F.col("convergent"))
        .alias("evidence_summary"),
        "representative_quotes", "frequency_score", "severity_score", "vote_momentum_score",
    )
    if level == "summary":
        return base.drop("theme_idx", "frequency_score", "severity_score", "vote_momentum_score")
    titles = _ranked_join(a.titles(), "theme_idx", "title_rank", "title", "data_point_titles")
    totals = qt.title_totals(a.points)
    return base.join(titles, "theme_idx", "left").join(totals, "theme_idx", "left").select(
        *[c for c in base.columns if c != "theme_idx"], "data_points_total", "data_point_titles",
        F.coalesce("data_point_titles_truncated", F.lit(False)).alias("data_point_titles_truncated"))


def plan_priorities(a, p: Params) -> DataFrame:
    """The first ``max_priorities`` themes with evidence and quotes."""
    s = a.scores.filter(F.col("rank") <= p.max_priorities)
    quotes = _ranked_join(a.quotes(), "theme_idx", "quote_rank", "quote", "customer_quotes")
    out = s.join(quotes, "theme_idx", "left").select(
        "rank", F.col("label").alias("theme"), "theme_id", "category",
        sc.signal_type(F.col("convergent"), F.col("reactive_count")).alias("signal_type"),
        "priority_score", "convergent",
        (F.col("reactive_count") + F.col("proactive_count")).cast("bigint").alias("total_data_points"),
        F.col("reactive_count").alias("support_tickets"), F.col("proactive_count").alias("feature_requests"),
        sc.evidence_summary(F.col("reactive_count"), F.col("proactive_count"), F.col("convergent"))
        .alias("evidence_summary"),
        "customer_quotes",
    )
    if p.detail_level != "summary":
        out = out.join(a.scores.select("rank", "frequency_score", "severity_score", "vote_momentum_score"), "rank")
    return out


def _sources():
    """The feeds (two at most), tickets first."""
    return F.sort_array(F.collect_list("data_source"), asc=False)


def _generated_at(p: Params) -> str:
    return p.as_of.strftime("%Y-%m-%dT%H:%M:%S.000Z")


def plan_markdown(a, p: Params) -> DataFrame:
    """The Markdown brief as ``(line_no, line)``; sections omitted when empty.

    Every input here is bounded (<= 10 priorities x <= 3 quotes, 3 emerging),
    so one small sort numbers the lines.
    """
    spark = a.signals.sparkSession
    summ = a.summary()
    sources = a.data_sources().agg(F.array_join(_sources(), ", ").alias("src"))
    head = attach_row(summ, sources).select(F.posexplode(F.array(
        F.concat(F.lit(f"# Product Plan — {p.timeframe_days}-day window")),
        F.lit(""),
        F.concat(F.lit(f"_Generated {_generated_at(p)} · methodology v{METHODOLOGY_VERSION} · sources: "),
                 F.when(F.col("src") == "", F.lit("none")).otherwise(F.col("src")), F.lit("_")),
        F.lit(""),
        F.concat(F.lit("**Signals:** "), F.col("total_data_points").cast("string"), F.lit(" analyzed ("),
                 F.col("reactive_count").cast("string"), F.lit(" support tickets, "),
                 F.col("proactive_count").cast("string"), F.lit(" feature requests) · "),
                 F.col("themes_detected").cast("string"), F.lit(" themes ("), F.col("convergent_themes").cast("string"),
                 F.lit(" convergent) · "), F.col("unmatched_count").cast("string"), F.lit(" unmatched")),
        F.lit(""),
    )).alias("k", "line")).select(F.lit(0).alias("sec"), F.lit(0).alias("r"), F.col("k").cast("bigint"), "line")
    pr = plan_priorities(a, p)
    score = sc.js_number(F.col("priority_score"))
    table_rows = pr.select(F.lit(2).alias("sec"), F.col("rank").alias("r"), F.lit(0).cast("bigint").alias("k"), F.concat(
        F.lit("| "), F.col("rank").cast("string"), F.lit(" | "), F.col("theme"), F.lit(" | "), score, F.lit(" | "),
        F.col("support_tickets").cast("string"), F.lit(" | "), F.col("feature_requests").cast("string"), F.lit(" | "),
        F.when(F.col("convergent"), F.lit("Convergent")).otherwise(F.col("signal_type")), F.lit(" |")).alias("line"))
    has_pr = pr.select(F.lit(1).alias("one")).limit(1)
    table_head = has_pr.select(F.posexplode(F.array(F.lit("## Priorities"), F.lit(""),
                                                    F.lit("| # | Theme | Score | Tickets | FRs | Signal |"),
                                                    F.lit("|---|-------|------:|--------:|----:|--------|")))
                               .alias("k", "line"))
    table_head = table_head.select(F.lit(1).alias("sec"), F.lit(0).alias("r"), F.col("k").cast("bigint"), "line")
    table_tail = has_pr.select(F.lit(3).alias("sec"), F.lit(0).alias("r"), F.lit(0).cast("bigint").alias("k"),
                               F.lit("").alias("line"))
    ranks = a.scores.filter(F.col("rank") <= p.max_priorities).select("theme_idx", "rank")
    quotes = a.quotes().filter((F.col("quote") != "") & (F.col("quote") != qt.NO_QUOTE)).join(ranks, "theme_idx")
    heads = pr.select(F.col("rank"), F.posexplode(F.array(
        F.concat(F.lit("### "), F.col("rank").cast("string"), F.lit(". "), F.col("theme"), F.lit("  ("),
                 F.col("category"), F.lit(" · score "), score, F.lit(")")),
        F.col("evidence_summary"))).alias("k", "line"))
    gap = quotes.select("rank").distinct().select("rank", F.lit(2).alias("k"), F.lit("").alias("line"))
    qlines = quotes.select("rank", (F.col("quote_rank") + 2).alias("k"), F.concat(F.lit("- "), F.col("quote")).alias("line"))
    tails = pr.select("rank", F.lit(1000).alias("k"), F.lit("").alias("line"))
    detail = heads.unionByName(gap).unionByName(qlines).unionByName(tails).select(
        F.lit(4).alias("sec"), F.col("rank").alias("r"), F.col("k").cast("bigint").alias("k"), "line")
    em_top = qt.emerging_top(a.emerging, 3)
    em_lines = em_top.select(F.lit(6).alias("sec"), F.lit(0).alias("r"), F.col("rk"), F.concat(
        F.lit("- "), F.col("ngram"), F.lit(" ("), F.col("frequency").cast("string"), F.lit(")")).alias("line"))
    w_em = Window.orderBy("rk")
    em_lines = em_lines.select("sec", "r", F.row_number().over(w_em).cast("bigint").alias("k"), "line")
    has_em = em_top.select(F.lit(1).alias("one")).limit(1)
    em_head = has_em.select(F.posexplode(F.array(F.lit("## Emerging themes"), F.lit(""))).alias("k", "line")).select(
        F.lit(5).alias("sec"), F.lit(0).alias("r"), F.col("k").cast("bigint"), "line")
    em_tail = has_em.select(F.lit(7).alias("sec"), F.lit(0).alias("r"), F.lit(0).cast("bigint").alias("k"),
                            F.lit("").alias("line"))
    parts = [head, table_head, table_rows, table_tail, detail, em_head, em_lines, em_tail]
    if p.kpi_context:
        kpi = spark.range(1).select(F.posexplode(F.array(F.lit("## Business context (KPI)"), F.lit(""),
                                                         F.lit(p.kpi_context.rstrip()), F.lit(""))).alias("k", "line"))
        parts.append(kpi.select(F.lit(8).alias("sec"), F.lit(0).alias("r"), F.col("k").cast("bigint"), "line"))
    allp = parts[0]
    for part in parts[1:]:
        allp = allp.unionByName(part.select("sec", "r", "k", "line"))
    w = Window.orderBy("sec", "r", "k")
    numbered = allp.withColumn("line_no", F.row_number().over(w).cast("bigint"))
    # trimEnd: drop trailing empty lines
    last = numbered.filter(F.col("line") != "").agg(F.max("line_no").alias("last"))
    return attach_row(numbered, last).filter(F.col("line_no") <= F.col("last")).select("line_no", "line")


def plan_markdown_text(a, p: Params) -> DataFrame:
    """The brief as one string ending with exactly one newline (one bounded row)."""
    lines = plan_markdown(a, p)
    return lines.agg(F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "line"))),
                                                       lambda s: s["line"]), "\n"), F.lit("\n")).alias("markdown"))


def feature_requests(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Feature-requests job: portal + status filter (before comments), scrub;
    comments are counted from the long comment table (no per-post list)."""
    sel.require_portal(fx.portals(spark, sf_dir), p)
    posts = sel.filter_status(sel.filter_portal(fx.posts(spark, sf_dir), p), p)
    clean = nz.requests_clean(posts)
    if p.include_comments:
        counts = fx.comments(spark, sf_dir).groupBy("portal", F.col("post_id").alias("id")).agg(
            F.count(F.lit(1)).alias("n_comments"))
        clean = clean.join(counts, ["portal", "id"], "left")
    else:
        clean = clean.withColumn("n_comments", F.lit(0))
    return clean.select(F.col("id").cast("bigint").alias("id"), "title", "description", "status", "portal",
                        F.col("votes_count").cast("bigint").alias("votes_count"),
                        F.col("comments_count").cast("bigint").alias("comments_count"),
                        F.coalesce("n_comments", F.lit(0)).cast("bigint").alias("n_comments"),
                        F.array_join("pii", SEP).alias("pii"))


def feature_request_comments(spark: SparkSession, sf_dir: str, p: Params) -> DataFrame:
    """Long comment rows of the selected posts, scrubbed; role kept, names never."""
    posts = sel.filter_status(sel.filter_portal(fx.posts(spark, sf_dir), p), p).select("portal", F.col("id").alias("post_id"))
    cm = fx.comments(spark, sf_dir).join(posts, ["portal", "post_id"], "left_semi")
    cm = px.with_scrub(cm, "comment", "comment_s", "pii")
    return cm.select("portal", "post_id", "pos", "role", F.col("comment_s").alias("comment"), "created_at", "pii")


def list_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mailboxes (id, name) and portals (name, base url); explicit allow-list."""
    mb = fx.mailboxes(spark, sf_dir).select(F.lit("mailbox").alias("kind"), F.col("id").cast("bigint").alias("id"),
                                           "name", F.lit(None).cast("string").alias("base_url"))
    pt = fx.portals(spark, sf_dir).select(F.lit("portal").alias("kind"), F.lit(None).cast("bigint").alias("id"),
                                         "name", "base_url")
    return mb.unionByName(pt)


def pii_audit(a) -> DataFrame:
    """Re-aimed dry run: redaction counts per source x category, plus which
    fields are sent and which are withheld."""
    cats = a.signals.select(F.when(F.col("source") == "REACTIVE", "support_tickets").otherwise("feature_votes")
                            .alias("source"), F.explode("pii").alias("category"))
    counts = cats.groupBy("source", "category").agg(F.count(F.lit(1)).cast("bigint").alias("signals"))
    return counts.select("source", "category", "signals")


def pii_audit_fields(a) -> DataFrame:
    """Re-aimed dry run by field: ``source, field, handling, category, signals``.

    ``redacted`` rows count the signals that had a category in a field; ``sent``
    and ``withheld`` rows name what leaves and what never does, from the
    columns of the cleaned feeds.
    """
    name = lambda reactive: F.when(reactive, "support_tickets").otherwise("feature_votes").alias("source")
    found = a.signals.select(name(F.col("source") == "REACTIVE"), F.explode("pii_fields").alias("f"))
    counts = (found.groupBy("source", "f.field", "f.category").agg(F.count(F.lit(1)).cast("bigint").alias("signals"))
              .select("source", "field", F.lit("redacted").alias("handling"), "category", "signals"))
    rows = [(feed, c, "withheld" if c in WITHHELD.get(feed, ()) else "sent") for feed, df in
            (("support_tickets", a.tickets), ("feature_votes", a.requests)) for c in df.columns if c not in INNER]
    listed = a.signals.sparkSession.createDataFrame(rows, "source string, field string, handling string").select(
        "source", "field", "handling", F.lit(None).cast("string").alias("category"), F.lit(None).cast("bigint").alias("signals"))
    return counts.unionByName(listed)


#: Columns of the cleaned feeds that only order or describe rows, and those that hold a placeholder or nothing of a feed's people.
INNER = ("pii", "pii_fields", "portal_pos", "feed_seq", "grp", "k1", "k2", "mailbox_id")
WITHHELD = {"support_tickets": ("customer_email",), "feature_votes": ("comments",)}


def _section(df: DataFrame, section: str, place, name, value) -> DataFrame:
    return df.select(F.lit(section).alias("section"), place.cast("bigint").alias("place"), name.cast("string").alias("name"),
                     value.cast("string").alias("value"))


def _pairs(spark: SparkSession, section: str, **values) -> DataFrame:
    rows = [(section, i, name, str(value)) for i, (name, value) in enumerate(values.items(), 1)]
    return spark.createDataFrame(rows, "section string, place bigint, name string, value string")


def _summary_section(a) -> DataFrame:
    s = a.summary()
    items = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("value")) for c in s.columns])
    return _section(s.select(F.posexplode(items).alias("i", "x")), "summary", F.col("i") + 1, F.col("x.name"), F.col("x.value"))


def _listed(df: DataFrame, column: str, section: str) -> DataFrame:
    """A few names (categories, feeds), sorted."""
    first = Window.orderBy(column)
    return _section(df.withColumn("i", F.row_number().over(first)), section, F.col("i"), F.col(column), F.lit(None))


def _theme_sections(a, most: int | None) -> list[DataFrame]:
    """Ranked themes with what is said of them, and their quotes."""
    s = a.scores if most is None else a.scores.filter(F.col("rank") <= most)
    said = F.concat_ws(" / ", "label", "category", sc.js_number(F.col("priority_score")),
                       sc.signal_type(F.col("convergent"), F.col("reactive_count")),
                       sc.evidence_summary(F.col("reactive_count"), F.col("proactive_count"), F.col("convergent")))
    quotes = a.quotes().join(s.select("theme_idx", "theme_id", "rank"), "theme_idx")
    return [_section(s, "themes", F.col("rank"), F.col("theme_id"), said),
            _section(quotes, "quotes", F.col("rank") * 10 + F.col("quote_rank"), F.col("theme_id"), F.col("quote"))]


def _emerging_sections(a, most: int | None, samples: int) -> list[DataFrame]:
    """The first emerging themes in claim order, with sample titles."""
    top = qt.emerging_top(a.emerging, most).withColumn("i", F.row_number().over(Window.orderBy("rk")))
    out = [_section(top, "emerging_themes", F.col("i"), F.col("ngram"), F.col("frequency"))]
    if samples:
        titles = qt.emerging_samples(a.emerging_points, samples).join(top.select("ngram", "i"), "ngram")
        out.append(_section(titles, "emerging_samples", F.col("i") * 10 + F.col("sample_rank"), F.col("ngram"), F.col("title")))
    return out


def _warnings(status: DataFrame | None) -> list[DataFrame]:
    if status is None:
        return []
    told = status.filter(F.col("warning").isNotNull()).withColumn("i", F.row_number().over(Window.orderBy("source")))
    return [_section(told, "warnings", F.col("i"), F.col("source"), F.col("warning"))]


def _together(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Emerging themes and sample titles of a detail level (all and none at ``full``, whose members are long tables).
EMERGING = {"summary": (5, 0), "standard": (10, 3), "full": (None, 0)}


def synthesis_rows(a, p: Params, level: str = "summary", status: DataFrame | None = None) -> DataFrame:
    """The whole synthesis as rows ``section, place, name, value``: run metadata, summary, redacted categories, feeds, themes,
    quotes, emerging themes, and the warnings of a landed run (``status``) if there are any."""
    spark = a.signals.sparkSession
    meta = _pairs(spark, "metadata", timeframe_days=p.timeframe_days, top_voted_limit=p.top_voted_limit,
                  portal_name=p.portal_name or "all", detail_level=level, pii_scrubbing_applied="true")
    return _together([meta, _summary_section(a), _listed(a.pii_categories(), "category", "pii_categories_redacted"),
                      _listed(a.data_sources(), "data_source", "data_sources"), *_theme_sections(a, None),
                      *_emerging_sections(a, *EMERGING[level]), *_warnings(status)])


def plan_rows(a, p: Params, status: DataFrame | None = None) -> DataFrame:
    """The whole plan as rows ``section, place, name, value``: metadata, summary, feeds, priorities with quotes, emerging themes
    with samples, the business context and warnings."""
    spark = a.signals.sparkSession
    meta = _pairs(spark, "metadata", generated_at=_generated_at(p), methodology_version=METHODOLOGY_VERSION,
                  methodology_resource=METHODOLOGY_RESOURCE, detail_level=p.detail_level, timeframe_days=p.timeframe_days,
                  pii_scrubbing_applied="true")
    kpi = {"provided": "true", "note": KPI_NOTE_GIVEN, "metrics": p.kpi_context} if p.kpi_context else {"provided": "false", "note": KPI_NOTE_NONE}
    return _together([meta, _summary_section(a), _listed(a.pii_categories(), "category", "pii_categories_redacted"),
                      _listed(a.data_sources(), "data_source", "data_sources"), *_theme_sections(a, p.max_priorities),
                      *_emerging_sections(a, 3, 2), _pairs(spark, "kpi_context", **kpi), *_warnings(status)])


def request_listing(posts: DataFrame, comments: DataFrame, p: Params) -> DataFrame:
    """The feature-request listing on any feed: every field that may leave, categories found in posts and in their comments.

    Status and portal are filtered before comments are met; comments are
    counted, not gathered.
    """
    clean = nz.requests_clean(sel.filter_status(sel.filter_portal(posts, p), p))
    out = clean.select("id", "title", "description", "status", "category", "portal", "url", "votes_count", "comments_count",
                       "created_at", "updated_at", "pii")
    if not p.include_comments:
        return out.withColumn("n_comments", F.lit(0).cast("bigint"))
    said = comments.withColumnRenamed("post_id", "id").join(clean.select("portal", "id").distinct(), ["portal", "id"], "left_semi")
    # at most one array for each set of categories
    found = px.with_scrub(said, "comment", "comment_s", "found").groupBy("portal", "id").agg(
        F.count(F.lit(1)).alias("n"), F.flatten(F.collect_set("found")).alias("found"))
    none = F.array().cast("array<string>")
    return (out.join(found, ["portal", "id"], "left")
            .withColumn("pii", F.array_sort(F.array_distinct(F.concat("pii", F.coalesce("found", none)))))
            .withColumn("n_comments", F.coalesce("n", F.lit(0)).cast("bigint")).drop("n", "found"))


# Fields sent and withheld per feed (dry-run listing).
FIELDS = {
    "support_tickets": {"sent": ["subject (PII-scrubbed)", "preview snippet (PII-scrubbed)", "tags", "status",
                                 "created/closed timestamps", "thread count"],
                        "withheld": ["customer email (always redacted)", "full thread/message bodies (never fetched)",
                                     "attachments"]},
    "feature_votes": {"sent": ["title (PII-scrubbed)", "description (PII-scrubbed)", "vote count", "comment count",
                               "status", "timestamps"],
                      "withheld": ["comment text (not fetched by this tool)", "voter identities",
                                   "commenter names and emails"]},
}


def write_synthesis(a, level: str, path: str) -> None:
    """S9 sink: run metadata + bounded per-theme view as JSON; for ``full`` the
    member lists are written as long JSON-lines tables in parallel."""
    p = a.params
    meta = attach_row(a.summary(),
                      a.pii_categories().agg(F.sort_array(F.collect_list("category")).alias("pii_categories_redacted")))
    meta = meta.select("*", F.lit(p.timeframe_days).alias("timeframe_days"), F.lit(level).alias("detail_level"),
                       F.lit(p.top_voted_limit).alias("top_voted_limit"),
                       F.lit(p.portal_name or "all").alias("portal_name"), F.lit(True).alias("pii_scrubbing_applied"))
    meta.coalesce(1).write.mode("overwrite").json(f"{path}/run")
    if level == "full":
        a.scores.write.mode("overwrite").json(f"{path}/themes")
        a.points.select("theme_idx", "ord", "id", "source", "title").write.mode("overwrite").json(f"{path}/theme_points")
        a.emerging.write.mode("overwrite").json(f"{path}/emerging")
        a.emerging_points.write.mode("overwrite").json(f"{path}/emerging_points")
        return
    themes_view(a, level).write.mode("overwrite").json(f"{path}/themes")
    k = 5 if level == "summary" else 10
    em = qt.emerging_top(a.emerging, k)
    if level == "standard":
        samples = _ranked_join(qt.emerging_samples(a.emerging_points, 3), "ngram", "sample_rank", "title",
                               "sample_titles")
        em = em.join(samples, "ngram", "left")
    em.select(F.col("ngram").alias("pattern"), *[c for c in em.columns if c not in ("ngram",)]).write.mode(
        "overwrite").json(f"{path}/emerging")


def dry_run_json() -> str:
    return json.dumps(FIELDS, indent=2)


def kpi_block(p: Params):
    """business context carried verbatim (never scrubbed), with its note."""
    if p.kpi_context:
        return F.struct(F.lit(True).alias("provided"), F.lit(KPI_NOTE_GIVEN).alias("note"),
                        F.lit(p.kpi_context).alias("metrics"))
    return F.struct(F.lit(False).alias("provided"), F.lit(KPI_NOTE_NONE).alias("note"))


def plan_document(a, p: Params) -> DataFrame:
    """S9 for the plan: one JSON row assembled from config-bounded parts
    (<= 10 priorities x 3 quotes / 50 titles, 3 emerging x 2 samples)."""
    pr = plan_priorities(a, p)
    quotes = a.quotes().join(a.scores.select("theme_idx", "rank"), "theme_idx")
    qarr = quotes.groupBy("rank").agg(F.transform(F.array_sort(F.collect_list(F.struct("quote_rank", "quote"))),
                                                  lambda s: s["quote"]).alias("customer_quotes_arr"))
    pr = pr.join(qarr, "rank", "left")
    ev = [F.col("total_data_points"), F.col("support_tickets"), F.col("feature_requests")]
    if p.detail_level != "summary":
        ev += [F.col("frequency_score"), F.col("severity_score"), F.col("vote_momentum_score")]
        tarr = a.titles().join(a.scores.select("theme_idx", "rank"), "theme_idx").groupBy("rank").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("title_rank", "title"))), lambda s: s["title"])
            .alias("data_point_titles"))
        pr = pr.join(tarr, "rank", "left").join(
            qt.title_totals(a.points).join(a.scores.select("theme_idx", "rank"), "theme_idx")
            .select("rank", "data_points_total", "data_point_titles_truncated"), "rank", "left")
    item = [F.col("rank"), F.col("theme"), F.col("theme_id"), F.col("category"), F.col("signal_type"),
            F.col("priority_score"), F.col("convergent"), F.struct(*ev).alias("evidence"),
            F.col("evidence_summary"), F.col("customer_quotes_arr").alias("customer_quotes")]
    if p.detail_level != "summary":
        item += [F.col("data_points_total"), F.col("data_point_titles"), F.col("data_point_titles_truncated")]
    prios = pr.agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("_k"), F.struct(*item).alias("v")))),
                               lambda s: s["v"]).alias("priorities"))
    em = qt.emerging_top(a.emerging, 3)
    samples = qt.emerging_samples(a.emerging_points, 2).groupBy("ngram").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("sample_rank", "title"))), lambda s: s["title"])
        .alias("sample_titles"))
    emj = em.join(samples, "ngram", "left").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        F.col("rk").alias("_k"), F.struct(F.col("ngram").alias("pattern"), "frequency", "sample_titles").alias("v")))),
        lambda s: s["v"]).alias("emerging_themes"))
    s = a.summary()
    summary = F.struct(F.col("total_data_points").alias("total_signals_analyzed"),
                       F.col("reactive_count").alias("reactive_signals"),
                       F.col("proactive_count").alias("proactive_signals"), "themes_detected", "convergent_themes",
                       F.col("unmatched_count").alias("unmatched_signals"))
    src = a.data_sources().agg(_sources().alias("data_sources"))
    pii = a.pii_categories().agg(F.array_sort(F.collect_list("category")).alias("pii_categories_redacted"))
    doc = attach_row(attach_row(attach_row(attach_row(s, src), pii), prios), emj).select(F.struct(
        F.lit(_generated_at(p)).alias("generated_at"), F.lit(METHODOLOGY_VERSION).alias("methodology_version"),
        F.lit(METHODOLOGY_RESOURCE).alias("methodology_resource"), F.lit(p.detail_level).alias("detail_level"),
        F.lit(p.timeframe_days).alias("timeframe_days"), "data_sources", F.lit(True).alias("pii_scrubbing_applied"),
        "pii_categories_redacted", summary.alias("summary"), "priorities", "emerging_themes",
        kpi_block(p).alias("kpi_context")).alias("plan"))
    return doc.select(F.to_json("plan").alias("plan_json"))
