"""Registered queries: one per operator of the inventory, over the driver tables.

Every query reads the given tables (or data Spark derives from them) whole.
Outputs are flat tables with scalar columns (arrays joined with ``|``),
integers as BIGINT and scores as DOUBLE, so they compare 1:1 with the SQL
oracle in :mod:`signalmesh.checks.oracle`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmesh.config import DEFAULT_THEMES, FIXTURE_THEMES
from signalmesh.functions import pii as px
from signalmesh.functions import scoring as sc
from signalmesh.functions import text as tx
from signalmesh.operators import emerging as em
from signalmesh.operators import keyword_index as ki
from signalmesh.operators import normalize as nz
from signalmesh.operators import quotes as qt
from signalmesh.operators import selection as sel
from signalmesh.operators import themes as th
from signalmesh.params import Params
from signalmesh.plans import analysis as an
from signalmesh.plans import jobs
from signalmesh.session import ensure_checkpoint_dir, materialize
from signalmesh.sources import fixtures as fx
from signalmesh.sources import landed as ld
from signalmesh.sources import pages as pg

SEP = "|"
#: The priorities of the plan document.
PLAN_DOCUMENT = ("priorities array<struct<rank:bigint, theme:string, theme_id:string, category:string, signal_type:string, "
                 "priority_score:double, convergent:boolean, "
                 "evidence:struct<total_data_points:bigint, support_tickets:bigint, feature_requests:bigint>, "
                 "evidence_summary:string, customer_quotes:array<string>>>")
_CACHE: dict = {}


def files_state(spark: SparkSession, sf_dir: str, *names: str) -> tuple:
    """Sizes and times of the tables' files as one number each: a scan without columns."""
    file = F.struct(*[f"_metadata.{c}" for c in ("file_path", "file_size", "file_modification_time")])
    frames = [fx.table(spark, sf_dir, n).select(F.xxhash64(file).alias("h")).distinct().agg(F.bit_xor("h"), F.count("*")) for n in names]
    return tuple(tuple(df.first()) for df in frames)


def analysis(spark: SparkSession, sf_dir: str, **kw) -> an.Analysis:
    """One written analysis per (session, tables as they are now, parameters)."""
    key = (spark.sparkContext.applicationId, sf_dir, files_state(spark, sf_dir, "documents", "conversations"), tuple(sorted(kw.items())))
    if key not in _CACHE:
        p = Params(**{k: v for k, v in kw.items() if k != "cfg"})
        _CACHE[key] = an.analyze(an.fixture_feeds(spark, sf_dir), kw.get("cfg", FIXTURE_THEMES), p)
    return _CACHE[key]


def ts_str(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def joined(arr: Column) -> Column:
    return F.array_join(arr, SEP)


def _docs(spark, sf):
    return fx.text_table(spark, sf, "documents", "doc_id")


# ---------------------------------------------------------------- sources / sinks

def q_list_sources(spark, sf):
    return jobs.list_sources(spark, sf)


def q_data_sources(spark, sf):
    return analysis(spark, sf).data_sources()


def q_post_comments(spark, sf):
    """Comments attached per post (left join; none -> zero), as bounded
    per-post aggregates -- the comment list itself stays a long table (J4)."""
    posts = fx.posts(spark, sf).select("portal", "id")
    c = fx.comments(spark, sf)
    per_post = c.groupBy("portal", F.col("post_id").alias("id")).agg(
        F.count(F.lit(1)).alias("n_comments"),
        F.count(F.when(F.col("role") == "admin", 1)).alias("n_admin"),
        F.min_by("comment", "pos").alias("first_comment"),
        F.max_by("comment", "pos").alias("last_comment"))
    out = posts.join(per_post, ["portal", "id"], "left")
    return out.select(F.col("id").cast("bigint").alias("post_id"),
                      F.coalesce("n_comments", F.lit(0)).cast("bigint").alias("n_comments"),
                      F.coalesce("n_admin", F.lit(0)).cast("bigint").alias("n_admin"),
                      "first_comment", "last_comment")


def q_portal_label(spark, sf):
    """Each post stamped with its own portal."""
    return fx.posts(spark, sf).select(F.col("id").cast("bigint").alias("id"), "portal")


def _page_json(df: DataFrame, page: Column, body) -> DataFrame:
    """Land rows as JSON page envelopes (a page holds a bounded run of ids)."""
    g = df.groupBy(page.alias("page_no")).agg(F.collect_list(F.struct(*df.columns)).alias("items"))
    return g.select("page_no", F.to_json(body(F.col("items"))).alias("json"))


def _ticket_pages(spark, sf):
    t = fx.tickets(spark, sf).select(
        "id", "number", "subject", "status", F.lit("published").alias("state"), F.col("mailbox_id").alias("mailboxId"),
        F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("createdAt"),
        F.lit(None).cast("string").alias("closedAt"),
        F.transform("tags", lambda x: F.struct(F.lit(0).cast("bigint").alias("id"), x.alias("tag"))).alias("tags"),
        F.struct(F.lit(None).cast("string").alias("email")).alias("primaryCustomer"), "preview", "threads")
    return _page_json(t, F.floor(F.col("id") / 50), lambda items: F.struct(
        F.struct(items.alias("conversations")).alias("_embedded"),
        F.struct(F.size(items).cast("bigint").alias("size")).alias("page")))


def q_ticket_pages(spark, sf):
    """Tickets landed as 50-per-page envelopes, parsed back with the declared schema."""
    landed = _ticket_pages(spark, sf)
    parsed = landed.select("page_no", F.from_json("json", pg.TICKET_PAGE).alias("p"))
    rows = pg.ticket_rows(parsed, F.col("page_no"))
    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("mailbox_id").cast("bigint").alias("mailbox_id"),
                       "subject", F.array_join(F.transform("tags", lambda x: x["tag"]), SEP).alias("tags"),
                       F.col("threads").cast("bigint").alias("threads"), "created_at")


def _mailbox_pages(spark, sf):
    m = fx.mailboxes(spark, sf).select("id", "name")
    return _page_json(m, F.floor(F.col("id") / 2), lambda items: F.struct(
        F.struct(items.alias("mailboxes")).alias("_embedded")))


def q_mailbox_pages(spark, sf):
    """S3: mailboxes landed two per page and parsed back."""
    landed = _mailbox_pages(spark, sf)
    parsed = landed.select("page_no", F.from_json("json", pg.MAILBOX_PAGE).alias("p"))
    return pg.mailbox_rows(parsed).select(F.col("id").cast("bigint").alias("id"), "name")


def _post_pages(spark, sf):
    p = fx.posts(spark, sf)
    items = p.select("portal", F.floor(F.col("id") / 30).alias("page_no"), F.col("id").cast("string").alias("id"),
                     "title", "description",
                     F.struct(F.lit(0).cast("bigint").alias("id"), F.col("status").alias("name"),
                              F.lit("").alias("color")).alias("status"),
                     F.lit(None).cast("struct<id:bigint,name:string,color:string>").alias("category"),
                     "votes_count", "comments_count",
                     F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("created_at"),
                     F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("updated_at"), "url")
    item = F.struct(*[c for c in items.columns if c not in ("portal", "page_no")])
    g = items.groupBy("portal", "page_no").agg(F.transform(
        F.array_sort(F.collect_list(F.struct(F.col("id").cast("bigint").alias("k"), item.alias("v")))), lambda x: x["v"]).alias("data"))
    return g.select("portal", F.to_json(F.struct(F.col("data"), (F.col("page_no") * 30).cast("bigint").alias("skip"),
                                                   F.lit(10).cast("bigint").alias("limit"))).alias("json"))


def q_post_pages(spark, sf):
    """Posts landed as skip/limit pages (bounded id ranges per portal), parsed back."""
    landed = _post_pages(spark, sf)
    parsed = landed.select("portal", F.from_json("json", pg.POST_PAGE).alias("p"))
    rows = pg.post_rows(parsed, F.col("portal"))
    return rows.select(F.col("id").cast("bigint").alias("id"), "portal", "title", F.col("status.name").alias("status"),
                       F.col("votes_count").cast("bigint").alias("votes_count"))


def _landed(spark, sf):
    """The tables landed as page files, a folder a source, and read back."""
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tables/pages-{uuid.uuid4().hex}"
    _ticket_pages(spark, sf).select("json").write.text(f"{base}/tickets")
    _mailbox_pages(spark, sf).select("json").write.text(f"{base}/mailboxes")
    _post_pages(spark, sf).select("portal", F.col("json").alias("value")).write.partitionBy("portal").text(f"{base}/posts")
    portals = [(r["name"], r.base_url, f"{base}/posts/portal={r['name']}") for r in fx.portals(spark, sf).orderBy("name").collect()]
    _comment_payloads(spark, sf).write.partitionBy("portal").json(f"{base}/comments")
    return ld.read_landed(spark, f"{base}/tickets", f"{base}/mailboxes", portals,
                          {name: f"{base}/comments/portal={name}" for name, *_ in portals})


def q_source_status(spark, sf):
    """Pages read and unreadable of every landed source, from the pass that reads its rows."""
    return _landed(spark, sf).status


def q_landed_synthesis(spark, sf):
    """The synthesis on landed pages instead of tables."""
    return jobs.themes_view(an.analyze(an.landed_feeds(_landed(spark, sf)), FIXTURE_THEMES, Params()), "summary")


def _comment_payloads(spark, sf):
    """Per post the payload of its comments: an array, or without one where there is a single comment."""
    c = fx.comments(spark, sf).groupBy("portal", F.col("post_id").cast("string").alias("post_id")).agg(
        F.array_sort(F.collect_list(F.struct("pos", "comment", F.struct("role", F.lit("A Name").alias("name")).alias("author")))).alias("c"))
    listed = F.transform("c", lambda x: x.dropFields("pos"))
    payload = F.when(F.size(listed) == 1, F.to_json(F.struct(listed[0].alias("data")))).otherwise(F.to_json(F.struct(listed.alias("data"))))
    return c.select("portal", "post_id", payload.alias("payload"))


def q_comment_payloads(spark, sf):
    """Comments out of payloads that hold one object or an array."""
    c = ld.comment_rows(_comment_payloads(spark, sf))
    return c.select("portal", F.col("post_id").cast("bigint").alias("post_id"), "role", "comment")


def q_keyword_index(spark, sf):
    """J1 by keyword index: every word and word pair of the conversations' first turns as keywords of 40 themes, over all documents."""
    first = fx.table(spark, sf, "conversations").filter("turn = 0").select("conv_id", F.lower("text").alias("t"))
    words = first.select((F.col("conv_id") % 40).cast("int").alias("theme_idx"), F.filter(
        F.regexp_extract_all("t", F.lit("[a-z0-9_]+"), 0), lambda w: F.length(w) > 3).alias("w"))
    pairs = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", F.get("w", i), w))
    keywords = words.select("theme_idx", F.explode(F.concat("w", pairs)).alias("keyword"))
    index = materialize(ki.keyword_index(keywords), "keyword-index")
    docs = _docs(spark, sf).select("doc_id", F.lower("text").alias("text"))
    hits = ki.match_by_index(docs, index, ["doc_id"])
    return hits.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("theme").cast("bigint").alias("theme_idx"))


# ---------------------------------------------------------------- filters

def q_tickets_in_window(spark, sf):
    t = sel.tickets_in_window(fx.tickets(spark, sf), Params())
    return t.select(F.col("id").cast("bigint").alias("id"), F.col("mailbox_id").cast("bigint").alias("mailbox_id"),
                    ts_str(F.col("created_at")).alias("created_at"))


def q_recent_posts(spark, sf):
    r = sel.recent_posts(fx.posts(spark, sf), Params())
    return r.select(F.col("id").cast("bigint").alias("id"), "portal", ts_str(F.col("created_at")).alias("created_at"))


def q_mailbox_filter(spark, sf):
    p = Params(mailbox_name="Europe")
    t = sel.filter_mailbox(sel.tickets_in_window(fx.tickets(spark, sf), p), fx.mailboxes(spark, sf), p)
    return t.select(F.col("id").cast("bigint").alias("id"), F.col("mailbox_id").cast("bigint").alias("mailbox_id"))


def q_portal_filter(spark, sf):
    r = sel.filter_portal(fx.posts(spark, sf), Params(portal_name="PORTAL_1"))
    return r.select(F.col("id").cast("bigint").alias("id"), "portal")


def q_status_filter(spark, sf):
    r = sel.filter_status(fx.posts(spark, sf), Params(status="planned"))
    return r.select(F.col("id").cast("bigint").alias("id"), "status")


def q_tickets_clean(spark, sf):
    t = analysis(spark, sf).tickets
    return t.select(F.col("id").cast("bigint").alias("id"), "subject", "preview", "customer_email",
                    joined(F.col("tags")).alias("tags"), F.size("customer_messages").cast("bigint").alias("n_messages"),
                    F.col("thread_count").cast("bigint").alias("thread_count"), joined(F.col("pii")).alias("pii"))


def q_requests_clean(spark, sf):
    r = analysis(spark, sf).requests
    return r.select(F.col("id").cast("bigint").alias("id"), "title", "description", "status", "portal",
                    F.col("votes_count").cast("bigint").alias("votes_count"),
                    F.col("comments_count").cast("bigint").alias("comments_count"), joined(F.col("pii")).alias("pii"))


def _signal_cols(df):
    return nz.with_text(df).select("id", "source", "title", "text")


def q_ticket_signals(spark, sf):
    return _signal_cols(analysis(spark, sf).signals.filter(F.col("source") == "REACTIVE"))


def q_request_signals(spark, sf):
    return _signal_cols(analysis(spark, sf).signals.filter(F.col("source") == "PROACTIVE"))


def q_agent_text_flag(spark, sf):
    c = fx.text_table(spark, sf, "conversations", "conv_id")
    return c.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                    tx.is_agent_text(F.col("text")).alias("is_agent"))


def q_include_comments(spark, sf):
    """request text with comments attached (feature-requests job form)."""
    posts = sel.filter_portal(fx.posts(spark, sf), Params())
    rc = nz.requests_clean(sel.attach_comment_list(posts, fx.comments(spark, sf)))
    return rc.select(F.col("id").cast("bigint").alias("id"),
                     F.size("comments").cast("bigint").alias("n_comments"),
                     F.lower(F.concat_ws(" ", "title", "description",
                                         F.transform("comments", lambda c: c["comment"]))).alias("text"))


def q_pii_run_categories(spark, sf):
    return analysis(spark, sf).pii_categories()


# ---------------------------------------------------------------- joins

def q_theme_match(spark, sf):
    a = analysis(spark, sf)
    return a.points.join(F.broadcast(a.themes.select("theme_idx", "theme_id")), "theme_idx").select(
        "theme_id", "id", "source")


def q_unmatched_signals(spark, sf):
    return analysis(spark, sf).unmatched.select("id", "source")


def q_quote_lookup(spark, sf):
    return qt.quote_lookup(analysis(spark, sf).signals)


def q_request_with_comments(spark, sf):
    rows = sel.request_comment_rows(fx.posts(spark, sf).select("portal", "id", "title"), fx.comments(spark, sf))
    return rows.select(F.col("id").cast("bigint").alias("id"), F.col("pos").cast("bigint").alias("pos"), "role",
                       "comment")


def q_mailbox_resolve(spark, sf):
    return sel.resolve_mailbox(fx.mailboxes(spark, sf), Params(mailbox_name="europe")).select(
        F.col("mailbox_id").cast("bigint").alias("mailbox_id"))


# ---------------------------------------------------------------- aggregates and scores

def _scores(spark, sf):
    return analysis(spark, sf).scores


def q_theme_counts(spark, sf):
    return _scores(spark, sf).select("theme_id", "points", "reactive_count", "proactive_count")


def q_theme_convergence(spark, sf):
    return _scores(spark, sf).select("theme_id", "convergent")


def q_frequency_score(spark, sf):
    return _scores(spark, sf).select("theme_id", "frequency_score")


def q_severity_score(spark, sf):
    return _scores(spark, sf).select("theme_id", "severity_score")


def q_vote_momentum(spark, sf):
    return _scores(spark, sf).select("theme_id", "vote_momentum_score")


def q_priority_score(spark, sf):
    return _scores(spark, sf).select("theme_id", "frequency_score", "severity_score", "vote_momentum_score",
                                     "priority_score")


def q_run_summary(spark, sf):
    return analysis(spark, sf).summary()


def _occurrences(spark, sf):
    a = analysis(spark, sf)
    return em.ngram_occurrences(a.unmatched, a.cfg.stop_words), a.cfg


def _seen(fs: Column) -> list[Column]:
    return [fs["ord"]["src"].cast("bigint").alias("seen_src"), fs["ord"]["portal"].alias("seen_portal"),
            fs["ord"]["grp"].cast("bigint").alias("seen_grp"), fs["ord"]["k1"].alias("seen_k1"),
            fs["ord"]["k2"].alias("seen_k2"), fs["pos"].cast("bigint").alias("seen_pos")]


def q_ngram_df(spark, sf):
    occ, cfg = _occurrences(spark, sf)
    s = em.ngram_stats(occ, cfg.emerging_theme_min_frequency)
    return s.select("ngram", F.col("df").cast("bigint").alias("df"))


def q_ngram_rank(spark, sf):
    """The rank key of every frequent n-gram (df desc, then first appearance)."""
    occ, cfg = _occurrences(spark, sf)
    s = em.ngram_stats(occ, cfg.emerging_theme_min_frequency)
    return s.select("ngram", F.col("df").cast("bigint").alias("df"), *_seen(F.col("first_seen")))


def q_emerging_themes(spark, sf):
    """A9 with each theme's rank key, so that the claim order is compared too."""
    e = analysis(spark, sf).emerging
    return e.select("ngram", "frequency", (-F.col("rk.neg_df")).cast("bigint").alias("df"), *_seen(F.col("rk.first_seen")))


def q_emerging_points(spark, sf):
    """The members each theme claimed."""
    return analysis(spark, sf).emerging_points.select("ngram", "id", "source", "title")


def q_theme_points(spark, sf):
    """A10: each theme's members with their order key (no per-theme sort: a theme
    may hold a large share of all points; ``ord`` orders them wherever needed)."""
    a = analysis(spark, sf)
    o = F.col("ord")
    return a.points.join(F.broadcast(a.themes.select("theme_idx", "theme_id")), "theme_idx").select(
        "theme_id", "id", "source", "title", o["src"].cast("bigint").alias("ord_src"), o["portal"].alias("ord_portal"),
        o["grp"].cast("bigint").alias("ord_grp"), o["k1"].alias("ord_k1"), o["k2"].alias("ord_k2"))


# ---------------------------------------------------------------- windows / top-k

def q_theme_ranking(spark, sf):
    return _scores(spark, sf).select("theme_id", "rank", "priority_score")


def q_top_voted_posts(spark, sf):
    t = sel.top_voted_posts(fx.posts(spark, sf), Params())
    return t.select("portal", F.col("id").cast("bigint").alias("id"), F.col("vote_rank").cast("bigint").alias("vote_rank"))


def q_selected_posts(spark, sf):
    s = sel.selected_posts(fx.posts(spark, sf), Params())
    return s.select("portal", F.col("id").cast("bigint").alias("id"), F.col("grp").cast("bigint").alias("grp"))


def q_theme_quotes(spark, sf):
    a = analysis(spark, sf)
    return a.quotes().join(F.broadcast(a.themes.select("theme_idx", "theme_id")), "theme_idx").select(
        "theme_id", "quote_rank", "quote")


def q_theme_titles(spark, sf):
    a = analysis(spark, sf)
    t = qt.theme_titles(a.points)
    return t.join(F.broadcast(a.themes.select("theme_idx", "theme_id")), "theme_idx").select(
        "theme_id", "title_rank", "title")


def q_title_totals(spark, sf):
    a = analysis(spark, sf)
    t = qt.title_totals(a.points)
    return t.join(F.broadcast(a.themes.select("theme_idx", "theme_id")), "theme_idx").select(
        "theme_id", "data_points_total", F.coalesce("data_point_titles_truncated", F.lit(False)).alias("truncated"))


def q_emerging_top(spark, sf):
    e = qt.emerging_top(analysis(spark, sf).emerging, 5)
    return e.select("ngram", "frequency")


def q_emerging_samples(spark, sf):
    a = analysis(spark, sf)
    return qt.emerging_samples(a.emerging_points, 3)


def q_plan_priorities(spark, sf):
    return jobs.plan_priorities(analysis(spark, sf), Params())


# ---------------------------------------------------------------- set operations

def q_all_signals(spark, sf):
    return analysis(spark, sf).signals.select("id", "source")


def q_all_portals(spark, sf):
    posts = fx.posts(spark, sf)
    parts = [posts.filter(F.col("portal") == f"portal_{i}") for i in range(fx.N_PORTALS)]
    return sel.all_portals(*parts).select("portal", F.col("id").cast("bigint").alias("id"))


# ---------------------------------------------------------------- scalar functions (whole documents)

def q_scrub_ssn(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   px.redact_ssn(F.coalesce("text", F.lit(""))).alias("text"))


def q_scrub_card(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), px.redact_cards(F.col("t")).alias("text"),
                    px.card_found(F.col("t")).alias("found"))


def q_scrub_email(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   px.redact_email(F.coalesce("text", F.lit(""))).alias("text"))


def q_scrub_phone(spark, sf):
    return _docs(spark, sf).select(F.col("doc_id").cast("bigint").alias("doc_id"),
                                   px.redact_phone(F.coalesce("text", F.lit(""))).alias("text"))


def q_scrub_text(spark, sf):
    d = px.with_scrub(_docs(spark, sf), "text", "scrubbed", "cats")
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("scrubbed").alias("text"))


def q_pii_categories(spark, sf):
    d = px.with_scrub(_docs(spark, sf), "text", "scrubbed", "cats")
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), joined(F.col("cats")).alias("categories"))


def q_scrub_array(spark, sf):
    """A document as its array of lines, scrubbed element-wise."""
    d = _docs(spark, sf).select("doc_id", F.split(F.coalesce("text", F.lit("")), "\n", -1).alias("lines"))
    s = d.select("doc_id", px.scrub_array_expr(F.col("lines")).alias("s"))
    return s.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.array_join(F.col("s.texts"), "\n").alias("text"),
                    joined(F.array_sort(F.col("s.pii"))).alias("categories"))


def q_keyword_match(spark, sf):
    """X8 with the shipped default catalogue over every whole document."""
    d = _docs(spark, sf).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    arr = th.matched_theme_array(DEFAULT_THEMES, "t")
    ids = F.array(*[F.lit(t.id) for t in DEFAULT_THEMES.themes])
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                    joined(F.transform(arr, lambda i: F.get(ids, i))).alias("themes"))


def _doc_tokens(spark, sf):
    d = _docs(spark, sf).select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select("doc_id", tx.tokens(F.col("t"), FIXTURE_THEMES.stop_words).alias("toks"))


def q_tokenize(spark, sf):
    t = _doc_tokens(spark, sf)
    return t.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size("toks").cast("bigint").alias("n_tokens"),
                    F.array_join("toks", " ").alias("tokens"))


def q_ngrams(spark, sf):
    t = _doc_tokens(spark, sf)
    g = t.select("doc_id", tx.ngrams(F.col("toks")).alias("g"))
    return g.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size("g").cast("bigint").alias("n_ngrams"),
                    joined(F.col("g")).alias("ngrams"))


def _ticket_points(spark, sf):
    return analysis(spark, sf).signals.filter(F.col("source") == "REACTIVE")


def q_recency_boost(spark, sf):
    s = _ticket_points(spark, sf)
    as_of = F.lit(Params().as_of).cast("timestamp_ntz")
    return s.select("id", sc.round2(sc.recency_boost(F.col("created_at"), as_of)).alias("recency_boost"))


def q_tag_boost(spark, sf):
    return _ticket_points(spark, sf).select("id", sc.tag_boost(F.col("tags")).alias("tag_boost"))


def q_thread_score(spark, sf):
    return _ticket_points(spark, sf).select("id", sc.thread_score(F.col("thread_count")).alias("thread_score"))


def q_round2(spark, sf):
    """X14 on a derived double: per-ticket severity contribution."""
    s = _ticket_points(spark, sf)
    as_of = F.lit(Params().as_of).cast("timestamp_ntz")
    v = sc.thread_score(F.col("thread_count")) + sc.recency_boost(F.col("created_at"), as_of) + sc.tag_boost(
        F.col("tags"))
    return s.select("id", sc.round2(v).alias("point_severity"))


def q_signal_type(spark, sf):
    return _scores(spark, sf).select("theme_id", sc.signal_type(F.col("convergent"), F.col("reactive_count"))
                                     .alias("signal_type"))


def q_evidence_summary(spark, sf):
    s = _scores(spark, sf)
    return s.select("theme_id", sc.evidence_summary(F.col("reactive_count"), F.col("proactive_count"),
                                                    F.col("convergent")).alias("evidence_summary"))


def q_quote_text(spark, sf):
    """The quotes that were made with the signals."""
    return qt.with_quote(analysis(spark, sf).signals).select("id", "quote")


def q_detail_projection(spark, sf):
    return jobs.themes_view(analysis(spark, sf), "standard")


# ---------------------------------------------------------------- end-to-end jobs

def q_synthesize_feedback(spark, sf):
    return jobs.themes_view(analysis(spark, sf), "summary")


def q_product_plan(spark, sf):
    return jobs.plan_priorities(analysis(spark, sf), Params())


def q_plan_markdown(spark, sf):
    return jobs.plan_markdown(analysis(spark, sf), Params(fmt="markdown"))


def q_plan_json(spark, sf):
    """The plan document (JSON) with the KPI pass-through block."""
    return jobs.plan_document(analysis(spark, sf), Params(kpi_context="churn 4.1% in EU; trial conversion flat"))


def q_feature_requests(spark, sf):
    return jobs.feature_requests(spark, sf, Params(status="open"))


def q_feature_request_comments(spark, sf):
    """The listing's comments as a long table, scrubbed."""
    c = jobs.feature_request_comments(spark, sf, Params(status="open"))
    return c.select("portal", F.col("post_id").cast("bigint").alias("post_id"), F.col("pos").cast("bigint").alias("pos"),
                    "role", "comment", joined(F.col("pii")).alias("pii"))


def q_synthesis_rows(spark, sf):
    """The whole synthesis at standard detail, as rows."""
    return jobs.synthesis_rows(analysis(spark, sf), Params(), "standard")


def q_plan_rows(spark, sf):
    """The whole plan with a business context, as rows."""
    return jobs.plan_rows(analysis(spark, sf), Params(kpi_context="churn 4.1% in EU; trial conversion flat"))


def q_plan_json_priorities(spark, sf):
    """The plan document read back: its priorities, a row a quote."""
    doc = jobs.plan_document(analysis(spark, sf), Params())
    read = doc.select(F.explode(F.from_json("plan_json", PLAN_DOCUMENT)["priorities"]).alias("p"))
    return read.select("p.rank", "p.theme", "p.theme_id", "p.category", "p.signal_type", "p.priority_score", "p.convergent",
                       F.col("p.evidence.total_data_points").alias("total_data_points"), F.col("p.evidence.support_tickets").alias("support_tickets"),
                       F.col("p.evidence.feature_requests").alias("feature_requests"), "p.evidence_summary",
                       joined(F.col("p.customer_quotes")).alias("customer_quotes"))


def q_feature_request_listing(spark, sf):
    """The listing with every field that may leave, comments counted and their categories named."""
    r = jobs.request_listing(fx.posts(spark, sf), fx.comments(spark, sf), Params(status="open"))
    return r.select(F.col("id").cast("bigint").alias("id"), "title", "description", "status", "category", "portal", "url", "votes_count",
                    "comments_count", "n_comments", ts_str(F.col("created_at")).alias("created_at"), ts_str(F.col("updated_at")).alias("updated_at"),
                    joined(F.col("pii")).alias("pii"))


def q_pii_audit_fields(spark, sf):
    return jobs.pii_audit_fields(analysis(spark, sf))


def q_pii_audit(spark, sf):
    return jobs.pii_audit(analysis(spark, sf))


QUERIES = {name[2:]: fn for name, fn in sorted(globals().items()) if name.startswith("q_") and callable(fn)}
