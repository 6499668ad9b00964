"""Oracle SQL (DuckDB dialect) for the registered queries.

Keys match :data:`signalmesh.plans.queries.QUERIES`; column names and types
match the Spark outputs.  The Markdown and JSON plan documents are absent.
"""

from __future__ import annotations

from signalmesh.checks import duck as d
from signalmesh.config import DEFAULT_THEMES, FIXTURE_THEMES
from signalmesh.functions.scoring import TAG_BOOST  # noqa: F401  (documented dependency)
from signalmesh.plans import jobs

A = d.with_analysis
TS = "strftime({c}, '%Y-%m-%d %H:%M:%S')"
NO_QUOTE = "No direct customer quote available"

SEVERITY_POINT = (f"least(coalesce(nullif(thread_count, 0), 1) * 10.0, 50.0) + CASE WHEN created_at IS NULL THEN 0.0 ELSE "
                  f"30.0 * exp(-(CASE WHEN date_diff('microsecond', created_at, {d.AS_OF}) < 0 THEN 0.0 ELSE "
                  f"CAST(date_diff('microsecond', created_at, {d.AS_OF}) AS DOUBLE) / 86400000000.0 END) / 7.0) END"
                  f" + {d.tag_boost('tags')}")
RECENCY = (f"CASE WHEN created_at IS NULL THEN 0.0 ELSE 30.0 * exp(-(CASE WHEN date_diff('microsecond', created_at, "
           f"{d.AS_OF}) < 0 THEN 0.0 ELSE CAST(date_diff('microsecond', created_at, {d.AS_OF}) AS DOUBLE) / "
           f"86400000000.0 END) / 7.0) END")

SIGNAL_TYPE = "CASE WHEN convergent THEN 'convergent' WHEN reactive_count > 0 THEN 'reactive' ELSE 'proactive' END"
EVIDENCE = ("CAST(reactive_count + proactive_count AS VARCHAR) || ' signals (' || concat_ws(', ', "
            "CASE WHEN reactive_count > 0 THEN CAST(reactive_count AS VARCHAR) || ' support tickets' END, "
            "CASE WHEN proactive_count > 0 THEN CAST(proactive_count AS VARCHAR) || ' feature requests' END) || ').'"
            " || CASE WHEN convergent THEN ' Convergent — appears in both support and feature requests "
            "(2x priority boost).' ELSE '' END")

QUOTES_CTE = f"""quote_lookup AS (SELECT id, arg_max(quote, (o_src, o_portal, o_grp, o_k1, o_k2)) AS quote
                     FROM signals GROUP BY id),
theme_quotes AS (
  SELECT theme_idx, quote_rank, quote FROM (
    SELECT p.theme_idx, l.quote,
           CAST(row_number() OVER (PARTITION BY p.theme_idx ORDER BY p.o_src, p.o_portal, p.o_grp, p.o_k1, p.o_k2)
                AS BIGINT) AS quote_rank
    FROM points p JOIN quote_lookup l ON l.id = p.id WHERE l.quote IS NOT NULL) WHERE quote_rank <= 3
  UNION ALL
  SELECT DISTINCT p.theme_idx, CAST(1 AS BIGINT), '{NO_QUOTE}' FROM points p
  WHERE NOT EXISTS (SELECT 1 FROM points p2 JOIN quote_lookup l ON l.id = p2.id
                    WHERE p2.theme_idx = p.theme_idx AND l.quote IS NOT NULL)),
quotes_joined AS (SELECT theme_idx, string_agg(quote, '|' ORDER BY quote_rank) AS q FROM theme_quotes GROUP BY theme_idx)"""

TITLES_CTE = """theme_titles AS (
  SELECT theme_idx, title_rank, title FROM (
    SELECT theme_idx, title, CAST(row_number() OVER (PARTITION BY theme_idx ORDER BY o_src, o_portal, o_grp, o_k1, o_k2)
                                  AS BIGINT) AS title_rank FROM points) WHERE title_rank <= 50),
titles_joined AS (SELECT theme_idx, string_agg(title, '|' ORDER BY title_rank) AS t FROM theme_titles GROUP BY theme_idx),
totals AS (SELECT theme_idx, CAST(count(*) AS BIGINT) AS data_points_total, count(*) > 50 AS truncated
           FROM points GROUP BY theme_idx)"""


def AQ(select: str) -> str:
    """Analysis CTEs plus the quote / title CTEs."""
    return ("WITH " + d.analysis_ctes() + ",\n" + QUOTES_CTE + ",\n" + TITLES_CTE + "\n"
            + select.replace("WITH_QUOTES", ""))


def docs_scrub(cols: str) -> str:
    return (f"WITH s AS (SELECT * FROM {d.scrub_from('documents', [('text', 'x')])})\n"
            f"SELECT CAST(doc_id AS BIGINT) AS doc_id, {cols} FROM s")


def _tokens_sql() -> str:
    toks = d.tokens("lower(coalesce(text, ''))", FIXTURE_THEMES)
    return f"SELECT doc_id, {toks} AS toks FROM documents"


NGRAM_OCC = f"""occ0 AS (SELECT o_src, o_portal, o_grp, o_k1, o_k2, unnest(g) AS ngram, generate_subscripts(g, 1) AS i
         FROM (SELECT *, {d.ngrams('toks')} AS g FROM (SELECT *, {d.tokens('text', FIXTURE_THEMES)} AS toks FROM unmatched))),
occ1 AS (SELECT o_src, o_portal, o_grp, o_k1, o_k2, ngram, min(i) AS i FROM occ0 GROUP BY ALL),
occ AS (SELECT *, row_number() OVER (PARTITION BY o_src, o_portal, o_grp, o_k1, o_k2 ORDER BY i) - 1 AS pos FROM occ1),
stats AS (SELECT ngram, count(*) AS df, min((o_src, o_portal, o_grp, o_k1, o_k2, pos)) AS fs FROM occ GROUP BY ngram
          HAVING count(*) >= {FIXTURE_THEMES.emerging_theme_min_frequency})"""


def with_ngrams(select: str) -> str:
    return "WITH " + d.analysis_ctes() + ",\n" + NGRAM_OCC + "\n" + select


# The walk one n-gram at a time, the claimed signals as its state.
_MIN = FIXTURE_THEMES.emerging_theme_min_frequency
WALK = f"""sig AS (SELECT *, row_number() OVER (ORDER BY o_src, o_portal, o_grp, o_k1, o_k2) AS sid FROM unmatched),
grams AS MATERIALIZED (
  SELECT r, s.ngram, s.df, s.fs, list(g.sid) AS sids
  FROM (SELECT *, row_number() OVER (ORDER BY df DESC, fs) AS r FROM stats) s JOIN occ o ON o.ngram = s.ngram
  JOIN sig g ON g.o_src = o.o_src AND g.o_portal = o.o_portal AND g.o_grp = o.o_grp AND g.o_k1 = o.o_k1 AND g.o_k2 = o.o_k2
  GROUP BY ALL),
walk(r, claimed, free) AS (
  SELECT CAST(0 AS BIGINT), []::BIGINT[], []::BIGINT[]
  UNION ALL
  SELECT gr, CASE WHEN len(f) >= {_MIN} THEN list_concat(claimed, f) ELSE claimed END, f
  FROM (SELECT g.r AS gr, w.claimed, list_filter(g.sids, lambda x: NOT list_contains(w.claimed, x)) AS f
        FROM walk w JOIN grams g ON g.r = w.r + 1)),
emerging AS (SELECT g.r, g.ngram, g.df, g.fs, len(w.free) AS frequency, w.free FROM walk w JOIN grams g ON g.r = w.r
             WHERE len(w.free) >= {_MIN}),
members AS (SELECT e.r, e.ngram, g.sid, g.id, g.source, g.title FROM (SELECT r, ngram, unnest(free) AS sid FROM emerging) e
            JOIN sig g ON g.sid = e.sid)"""
SEEN = (" CAST(df AS BIGINT) AS df, CAST(fs[1] AS BIGINT) AS seen_src, fs[2] AS seen_portal, CAST(fs[3] AS BIGINT) AS seen_grp,"
        " CAST(fs[4] AS BIGINT) AS seen_k1, CAST(fs[5] AS BIGINT) AS seen_k2, CAST(fs[6] AS BIGINT) AS seen_pos")


def with_walk(select: str) -> str:
    return "WITH RECURSIVE " + d.analysis_ctes() + ",\n" + NGRAM_OCC + ",\n" + WALK + "\n" + select


def keyword_sql() -> str:
    arr = d.theme_array("t", DEFAULT_THEMES)
    ids = "[" + ", ".join(d.lit(t.id) for t in DEFAULT_THEMES.themes) + "]"
    return (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, array_to_string(list_transform({arr}, lambda i: {ids}[i + 1]), '|')"
            f" AS themes FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")


def scrub_array_sql() -> str:
    x = d.scrub_expr("l")
    return (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, array_to_string(list_transform(s, lambda e: e.text), chr(10)) AS text, "
            f"array_to_string(list_sort(list_distinct(flatten(list_transform(s, lambda e: e.pii)))), '|') AS categories "
            f"FROM (SELECT doc_id, list_transform(string_split(coalesce(text, ''), chr(10)), lambda l: {x}) AS s "
            f"FROM documents)")


THEMES_VIEW_SUMMARY = f"""
SELECT r.rank, r.theme_id, r.label, r.category, r.priority_score, r.convergent, {SIGNAL_TYPE} AS signal_type,
       r.reactive_count, r.proactive_count, {EVIDENCE} AS evidence_summary, q.q AS representative_quotes
FROM ranked r LEFT JOIN quotes_joined q ON q.theme_idx = r.theme_idx"""

THEMES_VIEW_STANDARD = f"""
SELECT r.rank, r.theme_id, r.label, r.category, r.priority_score, r.convergent, {SIGNAL_TYPE} AS signal_type,
       r.reactive_count, r.proactive_count, {EVIDENCE} AS evidence_summary, q.q AS representative_quotes,
       r.frequency_score, r.severity_score, r.vote_momentum_score, tt.data_points_total, t.t AS data_point_titles,
       coalesce(tt.truncated, false) AS data_point_titles_truncated
FROM ranked r LEFT JOIN quotes_joined q ON q.theme_idx = r.theme_idx LEFT JOIN titles_joined t ON t.theme_idx = r.theme_idx
LEFT JOIN totals tt ON tt.theme_idx = r.theme_idx"""

PLAN_PRIORITIES = f"""
SELECT r.rank, r.label AS theme, r.theme_id, r.category, {SIGNAL_TYPE} AS signal_type, r.priority_score, r.convergent,
       CAST(r.reactive_count + r.proactive_count AS BIGINT) AS total_data_points, r.reactive_count AS support_tickets,
       r.proactive_count AS feature_requests, {EVIDENCE} AS evidence_summary, q.q AS customer_quotes
FROM ranked r LEFT JOIN quotes_joined q ON q.theme_idx = r.theme_idx WHERE r.rank <= 5"""


# Every keyword against every text: words between boundaries, pairs as substrings.
KEYWORD_INDEX = r"""
WITH first AS (SELECT CAST(conv_id % 40 AS BIGINT) AS theme_idx,
                      list_filter(regexp_extract_all(lower(text), '[a-z0-9_]+'), lambda x: length(x) > 3) AS w
               FROM conversations WHERE turn = 0),
words AS (SELECT DISTINCT theme_idx, unnest(w) AS keyword FROM first),
pairs AS (SELECT DISTINCT theme_idx, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS keyword FROM first),
docs AS (SELECT CAST(doc_id AS BIGINT) AS doc_id, lower(text) AS t FROM documents),
tokens AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(t, '[A-Za-z0-9_]+')) AS keyword FROM docs)
SELECT doc_id, theme_idx FROM tokens JOIN words USING (keyword)
UNION
SELECT doc_id, theme_idx FROM docs JOIN pairs ON contains(t, keyword)
"""


# Columns of the cleaned feeds, and which of them hold a placeholder or nothing.
FIELD_LIST = {"support_tickets": ("id", "number", "subject", "status", "created_at", "closed_at", "customer_email", "tags", "preview",
                                  "customer_messages", "thread_count"),
              "feature_votes": ("id", "title", "description", "status", "category", "votes_count", "comments_count", "portal", "url", "created_at",
                                "updated_at", "comments")}
FIELDS_SQL = " UNION ALL ".join(
    f"SELECT '{feed}', '{c}', '{'withheld' if c in ('customer_email', 'comments') else 'sent'}', NULL, NULL" for feed, cols in FIELD_LIST.items() for c in cols)
PII_FIELDS = ("WITH " + d.TICKETS_RAW + ", " + d.tickets_win() + ", " + d.POSTS_RAW + ", " + d.posts_sel() + ", t AS (SELECT * FROM "
              + d.scrub_from("tickets_win", [("subject", "subject_s"), ("preview", "preview_s")]) + "), r AS (SELECT * FROM "
              + d.scrub_from("posts_sel", [("title", "title_s"), ("description", "desc_s")]) + "), f AS ("
              "SELECT 'support_tickets' AS source, 'subject' AS field, unnest(subject_s_pii) AS category FROM t UNION ALL "
              "SELECT 'support_tickets', 'preview', unnest(preview_s_pii) FROM t UNION ALL "
              "SELECT 'feature_votes', 'title', unnest(title_s_pii) FROM r UNION ALL "
              "SELECT 'feature_votes', 'description', unnest(desc_s_pii) FROM r) "
              "SELECT source, field, 'redacted' AS handling, category, CAST(count(*) AS BIGINT) AS signals FROM f GROUP BY ALL UNION ALL " + FIELDS_SQL)


def _pairs(section: str, **values) -> str:
    return " UNION ALL ".join(f"SELECT {d.lit(section)}, CAST({i} AS BIGINT), {d.lit(n)}, {d.lit(str(v))}" for i, (n, v) in enumerate(values.items(), 1))


def response_sql(meta: str, most: int | None, emerging: int, samples: int, more: str = "") -> str:
    """The whole response of a job as rows ``section, place, name, value``."""
    top = f"WHERE rank <= {most}" if most else ""
    score = "regexp_replace(CAST(priority_score AS VARCHAR), '\\.0$', '')"
    summary = ["2 AS config_version", "8 AS known_themes_count", "(SELECT count(*) FROM signals) AS total_data_points"]
    counts = {"reactive_count": "signals WHERE source = 'REACTIVE'", "proactive_count": "signals WHERE source = 'PROACTIVE'",
              "themes_detected": "scores", "convergent_themes": "scores WHERE convergent", "unmatched_count": "unmatched"}
    summary += [f"(SELECT count(*) FROM {source}) AS {name}" for name, source in counts.items()]
    rows = " UNION ALL ".join(f"SELECT 'summary', CAST({i} AS BIGINT), {d.lit(x.rsplit(' AS ', 1)[1])}, CAST({x.rsplit(' AS ', 1)[0]} AS VARCHAR)"
                              for i, x in enumerate(summary, 1))
    select = f"""SELECT section, place, name, value FROM (
  {meta} UNION ALL {rows}
  UNION ALL SELECT 'pii_categories_redacted', row_number() OVER (ORDER BY c), c, NULL FROM (SELECT DISTINCT unnest(pii) AS c FROM signals)
  UNION ALL SELECT 'data_sources', row_number() OVER (ORDER BY c), c, NULL FROM (SELECT DISTINCT CASE WHEN source = 'REACTIVE'
    THEN 'support_tickets' ELSE 'feature_votes' END AS c FROM signals)
  UNION ALL SELECT 'themes', rank, theme_id, concat_ws(' / ', label, category, {score}, {SIGNAL_TYPE}, {EVIDENCE}) FROM ranked {top}
  UNION ALL SELECT 'quotes', r.rank * 10 + q.quote_rank, r.theme_id, q.quote FROM theme_quotes q
    JOIN (SELECT * FROM ranked {top}) r ON r.theme_idx = q.theme_idx
  UNION ALL SELECT 'emerging_themes', i, ngram, CAST(frequency AS VARCHAR) FROM top_emerging
  UNION ALL SELECT 'emerging_samples', t.i * 10 + m.n, m.ngram, m.title FROM (SELECT ngram, title, row_number() OVER
    (PARTITION BY ngram ORDER BY sid) AS n FROM members) m JOIN top_emerging t ON t.ngram = m.ngram WHERE m.n <= {samples}
  {more}) AS x(section, place, name, value)"""
    top_emerging = f"top_emerging AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY r) AS i FROM emerging) WHERE i <= {emerging})"
    return ("WITH RECURSIVE " + d.analysis_ctes() + ",\n" + QUOTES_CTE + ",\n" + NGRAM_OCC + ",\n" + WALK + ",\n" + top_emerging + "\n" + select)


def build() -> dict[str, str]:
    fr_sql = (f"WITH {d.POSTS_RAW}, {d.COMMENTS}, p AS (SELECT * FROM posts_raw WHERE lower(status) = 'open'), "
              f"s AS (SELECT id, status, portal, votes_count, comments_count, title_s, desc_s, "
              f"list_sort(list_distinct(list_concat(title_s_pii, desc_s_pii))) AS pii "
              f"FROM {d.scrub_from('p', [('title', 'title_s'), ('description', 'desc_s')])}), "
              f"c AS (SELECT post_id, count(*) AS n FROM comments GROUP BY post_id) "
              f"SELECT CAST(s.id AS BIGINT) AS id, title_s AS title, desc_s AS description, status, portal, "
              f"CAST(votes_count AS BIGINT) AS votes_count, CAST(comments_count AS BIGINT) AS comments_count, "
              f"CAST(coalesce(c.n, 0) AS BIGINT) AS n_comments, array_to_string(pii, '|') AS pii "
              f"FROM s LEFT JOIN c ON c.post_id = s.id")
    tokens = _tokens_sql()
    q = {
        # sources / sinks
        "list_sources": ("WITH " + d.POSTS_RAW + " SELECT 'mailbox' AS kind, CAST(r_regionkey AS BIGINT) AS id, r_name AS name,"
                         " CAST(NULL AS VARCHAR) AS base_url FROM region UNION ALL SELECT DISTINCT 'portal', CAST(NULL AS BIGINT),"
                         " portal, 'https://' || portal || '.example.invalid' FROM posts_raw"),
        "data_sources": A("SELECT DISTINCT CASE WHEN source = 'REACTIVE' THEN 'support_tickets' ELSE 'feature_votes' END"
                          " AS data_source FROM signals"),
        "post_comments": (f"WITH {d.COMMENTS} SELECT CAST(c.conv_id AS BIGINT) AS post_id,"
                          " CAST(count(m.pos) AS BIGINT) AS n_comments,"
                          " CAST(count(m.pos) FILTER (WHERE m.role = 'admin') AS BIGINT) AS n_admin,"
                          " arg_min(m.comment, m.pos) AS first_comment, arg_max(m.comment, m.pos) AS last_comment"
                          " FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN comments m ON m.post_id = c.conv_id"
                          " GROUP BY c.conv_id"),
        "portal_label": f"WITH {d.POSTS_RAW} SELECT CAST(id AS BIGINT) AS id, portal FROM posts_raw",
        "ticket_pages": (f"WITH {d.TICKETS_RAW} SELECT CAST(id AS BIGINT) AS id, CAST(mailbox_id AS BIGINT) AS mailbox_id,"
                         " subject, array_to_string(tags, '|') AS tags, CAST(threads AS BIGINT) AS threads,"
                         " strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at FROM tickets_raw"),
        "mailbox_pages": "SELECT CAST(r_regionkey AS BIGINT) AS id, r_name AS name FROM region",
        "post_pages": (f"WITH {d.POSTS_RAW} SELECT CAST(id AS BIGINT) AS id, portal, title, status,"
                       " CAST(votes_count AS BIGINT) AS votes_count FROM posts_raw"),
        "source_status": (f"WITH {d.POSTS_RAW} SELECT 'support_tickets' AS source, true AS ok, CAST(count(DISTINCT doc_id // 50) AS"
                          " BIGINT) AS pages, CAST(0 AS BIGINT) AS unreadable_pages, CAST(NULL AS VARCHAR) AS warning FROM documents"
                          " UNION ALL SELECT 'mailboxes', true, CAST(count(DISTINCT r_regionkey // 2) AS BIGINT), 0, NULL FROM region"
                          " UNION ALL SELECT portal, true, CAST(count(DISTINCT id // 30) AS BIGINT), 0, NULL FROM posts_raw GROUP BY portal"),
        "synthesis_rows": response_sql(_pairs("metadata", timeframe_days=30, top_voted_limit=50, portal_name="all", detail_level="standard",
                                              pii_scrubbing_applied="true"), None, 10, 3),
        "plan_rows": response_sql(
            _pairs("metadata", generated_at="2024-01-31T00:00:00.000Z", methodology_version=jobs.METHODOLOGY_VERSION,
                   methodology_resource=jobs.METHODOLOGY_RESOURCE, detail_level="summary", timeframe_days=30, pii_scrubbing_applied="true"),
            5, 3, 2, " UNION ALL " + _pairs("kpi_context", provided="true", note=jobs.KPI_NOTE_GIVEN,
                                            metrics="churn 4.1% in EU; trial conversion flat")),
        "plan_json_priorities": AQ("WITH_QUOTES" + PLAN_PRIORITIES),
        "feature_request_listing": (
            f"WITH {d.POSTS_RAW}, {d.COMMENTS}, p AS (SELECT * FROM posts_raw WHERE lower(status) = 'open'), "
            f"s AS (SELECT * FROM {d.scrub_from('p', [('title', 'title_s'), ('description', 'desc_s')])}), "
            f"c AS (SELECT post_id, count(*) AS n, flatten(list(comment_s_pii)) AS found FROM "
            f"{d.scrub_from('comments', [('comment', 'comment_s')])} GROUP BY post_id) "
            f"SELECT CAST(s.id AS BIGINT) AS id, title_s AS title, desc_s AS description, status, CAST(NULL AS VARCHAR) AS category, portal, "
            f"CAST(NULL AS VARCHAR) AS url, CAST(votes_count AS BIGINT) AS votes_count, CAST(comments_count AS BIGINT) AS comments_count, "
            f"CAST(coalesce(c.n, 0) AS BIGINT) AS n_comments, {TS.format(c='created_at')} AS created_at, {TS.format(c='created_at')} AS updated_at, "
            f"array_to_string(list_sort(list_distinct(list_concat(title_s_pii, desc_s_pii, coalesce(c.found, []::VARCHAR[])))), '|') AS pii "
            f"FROM s LEFT JOIN c ON c.post_id = s.id"),
        "pii_audit_fields": PII_FIELDS,
        "comment_payloads": (f"WITH {d.COMMENTS} SELECT 'portal_' || CAST(post_id % 3 AS VARCHAR) AS portal, CAST(post_id AS BIGINT)"
                             " AS post_id, role, comment FROM comments"),
        "keyword_index": KEYWORD_INDEX,
        "landed_synthesis": AQ("WITH_QUOTES" + THEMES_VIEW_SUMMARY),
        # filters
        "tickets_in_window": (f"WITH {d.TICKETS_RAW}, {d.tickets_win()} SELECT CAST(id AS BIGINT) AS id,"
                              f" CAST(mailbox_id AS BIGINT) AS mailbox_id, {TS.format(c='created_at')} AS created_at FROM tickets_win"),
        "recent_posts": (f"WITH {d.POSTS_RAW} SELECT CAST(id AS BIGINT) AS id, portal, {TS.format(c='created_at')} AS created_at"
                         f" FROM posts_raw WHERE created_at >= {d.window_lo()}"),
        "mailbox_filter": (f"WITH {d.TICKETS_RAW}, {d.tickets_win()} SELECT CAST(id AS BIGINT) AS id, CAST(mailbox_id AS BIGINT)"
                           " AS mailbox_id FROM tickets_win WHERE mailbox_id IN (SELECT arg_min(r_regionkey, r_regionkey)"
                           " FROM region WHERE lower(r_name) = lower('Europe'))"),
        "portal_filter": f"WITH {d.POSTS_RAW} SELECT CAST(id AS BIGINT) AS id, portal FROM posts_raw WHERE lower(portal) = 'portal_1'",
        "status_filter": f"WITH {d.POSTS_RAW} SELECT CAST(id AS BIGINT) AS id, status FROM posts_raw WHERE lower(status) = 'planned'",
        "tickets_clean": A("SELECT CAST(id AS BIGINT) AS id, subject_s AS subject, preview_s AS preview,"
                           " '[REDACTED]' AS customer_email, array_to_string(tags, '|') AS tags,"
                           " CAST(len(messages) AS BIGINT) AS n_messages, CAST(thread_count AS BIGINT) AS thread_count,"
                           " array_to_string(pii, '|') AS pii FROM tickets_clean"),
        "requests_clean": A("SELECT CAST(id AS BIGINT) AS id, title_s AS title, desc_s AS description, status, portal,"
                            " CAST(votes_count AS BIGINT) AS votes_count, CAST(comments_count AS BIGINT) AS comments_count,"
                            " array_to_string(pii, '|') AS pii FROM requests_clean"),
        "ticket_signals": A("SELECT id, source, title, text FROM signals WHERE source = 'REACTIVE'"),
        "request_signals": A("SELECT id, source, title, text FROM signals WHERE source = 'PROACTIVE'"),
        "agent_text_flag": (f"SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, {d.agent('text')}"
                            " AS is_agent FROM conversations"),
        "include_comments": (f"WITH {d.POSTS_RAW}, {d.COMMENTS}, "
                             f"s AS (SELECT id, title_s, desc_s FROM"
                             f" {d.scrub_from('posts_raw', [('title', 'title_s'), ('description', 'desc_s')])}), "
                             f"c AS (SELECT post_id, count(*) AS n, string_agg(({d.scrub_expr('comment')}).text, ' ' ORDER BY pos) AS t"
                             f" FROM comments GROUP BY post_id) "
                             f"SELECT CAST(s.id AS BIGINT) AS id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_comments,"
                             f" lower(concat_ws(' ', title_s, desc_s, c.t)) AS text FROM s LEFT JOIN c ON c.post_id = s.id"),
        "pii_run_categories": A("SELECT DISTINCT unnest(pii) AS category FROM signals"),
        # joins
        "theme_match": A("SELECT t.theme_id, p.id, p.source FROM points p JOIN themes t ON t.theme_idx = p.theme_idx"),
        "unmatched_signals": A("SELECT id, source FROM unmatched"),
        "quote_lookup": A("SELECT id, arg_max(quote, (o_src, o_portal, o_grp, o_k1, o_k2)) AS quote FROM signals GROUP BY id"),
        "request_with_comments": (f"WITH {d.POSTS_RAW}, {d.COMMENTS} SELECT CAST(p.id AS BIGINT) AS id, CAST(c.pos AS BIGINT)"
                                  " AS pos, c.role, c.comment FROM posts_raw p LEFT JOIN comments c ON c.post_id = p.id"),
        "mailbox_resolve": ("SELECT CAST(arg_min(r_regionkey, r_regionkey) AS BIGINT) AS mailbox_id FROM region"
                            " WHERE lower(r_name) = lower('europe') HAVING count(*) > 0"),
        # aggregates and scores
        "theme_counts": A("SELECT theme_id, points, reactive_count, proactive_count FROM scores"),
        "theme_convergence": A("SELECT theme_id, convergent FROM scores"),
        "frequency_score": A("SELECT theme_id, frequency_score FROM scores"),
        "severity_score": A("SELECT theme_id, severity_score FROM scores"),
        "vote_momentum": A("SELECT theme_id, vote_momentum_score FROM scores"),
        "priority_score": A("SELECT theme_id, frequency_score, severity_score, vote_momentum_score, priority_score FROM scores"),
        "run_summary": A("SELECT CAST(2 AS BIGINT) AS config_version, CAST(8 AS BIGINT) AS known_themes_count,"
                         " (SELECT CAST(count(*) AS BIGINT) FROM signals) AS total_data_points,"
                         " (SELECT CAST(count(*) AS BIGINT) FROM signals WHERE source = 'REACTIVE') AS reactive_count,"
                         " (SELECT CAST(count(*) AS BIGINT) FROM signals WHERE source = 'PROACTIVE') AS proactive_count,"
                         " (SELECT CAST(count(*) AS BIGINT) FROM scores) AS themes_detected,"
                         " (SELECT CAST(count(*) AS BIGINT) FROM scores WHERE convergent) AS convergent_themes,"
                         " (SELECT CAST(count(*) AS BIGINT) FROM unmatched) AS unmatched_count"),
        "ngram_df": with_ngrams("SELECT ngram, CAST(df AS BIGINT) AS df FROM stats"),
        "ngram_rank": with_ngrams("SELECT ngram, CAST(df AS BIGINT) AS df, CAST(fs[1] AS BIGINT) AS seen_src,"
                                  " fs[2] AS seen_portal, CAST(fs[3] AS BIGINT) AS seen_grp, CAST(fs[4] AS BIGINT) AS seen_k1,"
                                  " CAST(fs[5] AS BIGINT) AS seen_k2, CAST(fs[6] AS BIGINT) AS seen_pos FROM stats"),
        "emerging_themes": with_walk(f"SELECT ngram, CAST(frequency AS BIGINT) AS frequency, {SEEN} FROM emerging"),
        "emerging_points": with_walk("SELECT ngram, id, source, title FROM members"),
        "emerging_top": with_walk("SELECT ngram, CAST(frequency AS BIGINT) AS frequency FROM emerging ORDER BY r LIMIT 5"),
        "emerging_samples": with_walk("SELECT ngram, sample_rank, title FROM (SELECT ngram, title, CAST(row_number() OVER"
                                      " (PARTITION BY ngram ORDER BY sid) AS BIGINT) AS sample_rank FROM members)"
                                      " WHERE sample_rank <= 3"),
        "theme_points": A("SELECT t.theme_id, p.id, p.source, p.title, CAST(p.o_src AS BIGINT) AS ord_src,"
                          " p.o_portal AS ord_portal, CAST(p.o_grp AS BIGINT) AS ord_grp, p.o_k1 AS ord_k1,"
                          " p.o_k2 AS ord_k2 FROM points p JOIN themes t ON t.theme_idx = p.theme_idx"),
        # windows / top-k
        "theme_ranking": A("SELECT theme_id, rank, priority_score FROM ranked"),
        "top_voted_posts": (f"WITH {d.POSTS_RAW} SELECT portal, CAST(id AS BIGINT) AS id, CAST(vote_rank AS BIGINT) AS vote_rank"
                            " FROM (SELECT *, row_number() OVER (PARTITION BY portal ORDER BY coalesce(votes_count, 0) DESC,"
                            " feed_seq) AS vote_rank FROM posts_raw) WHERE vote_rank <= 50"),
        "selected_posts": (f"WITH {d.POSTS_RAW}, {d.posts_sel()} SELECT portal, CAST(id AS BIGINT) AS id, CAST(grp AS BIGINT)"
                           " AS grp FROM posts_sel"),
        "theme_quotes": AQ("WITH_QUOTES SELECT t.theme_id, q.quote_rank, q.quote FROM theme_quotes q"
                           " JOIN themes t ON t.theme_idx = q.theme_idx"),
        "theme_titles": AQ("WITH_QUOTES SELECT t.theme_id, x.title_rank, x.title FROM theme_titles x"
                           " JOIN themes t ON t.theme_idx = x.theme_idx"),
        "title_totals": AQ("WITH_QUOTES SELECT t.theme_id, x.data_points_total, x.truncated FROM totals x"
                           " JOIN themes t ON t.theme_idx = x.theme_idx"),
        "plan_priorities": AQ("WITH_QUOTES" + PLAN_PRIORITIES),
        # set operations
        "all_signals": A("SELECT id, source FROM signals"),
        "all_portals": f"WITH {d.POSTS_RAW} SELECT portal, CAST(id AS BIGINT) AS id FROM posts_raw",
        # scalar functions over whole documents
        "scrub_ssn": (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_replace(coalesce(text, ''), {d.lit(d.SSN)},"
                      " '[SSN REDACTED]', 'g') AS text FROM documents"),
        "scrub_card": (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, struct_extract(cw, 't') AS text, struct_extract(cw, 'h')"
                       f" AS found FROM (SELECT doc_id, {d.card_redact('tx0')} AS cw FROM (SELECT doc_id,"
                       f" coalesce(text, '') AS tx0 FROM documents))"),
        "scrub_email": (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CASE WHEN position('@' IN x) > 0 THEN regexp_replace(x,"
                        f" {d.lit(d.EMAIL)}, '[EMAIL REDACTED]', 'g') ELSE x END AS text FROM"
                        f" (SELECT doc_id, coalesce(text, '') AS x FROM documents)"),
        "scrub_phone": (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, regexp_replace(coalesce(text, ''), {d.lit(d.PHONE)},"
                        " '[PHONE REDACTED]', 'g') AS text FROM documents"),
        "scrub_text": docs_scrub("x AS text"),
        "pii_categories": docs_scrub("array_to_string(x_pii, '|') AS categories"),
        "scrub_array": scrub_array_sql(),
        "keyword_match": keyword_sql(),
        "tokenize": (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(toks) AS BIGINT) AS n_tokens,"
                     f" array_to_string(toks, ' ') AS tokens FROM ({tokens})"),
        "ngrams": (f"SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len(g) AS BIGINT) AS n_ngrams, array_to_string(g, '|')"
                   f" AS ngrams FROM (SELECT doc_id, {d.ngrams('toks')} AS g FROM ({tokens}))"),
        "recency_boost": A(f"SELECT id, {d.round2(RECENCY)} AS recency_boost FROM signals WHERE source = 'REACTIVE'"),
        "tag_boost": A(f"SELECT id, {d.tag_boost('tags')} AS tag_boost FROM signals WHERE source = 'REACTIVE'"),
        "thread_score": A("SELECT id, least(CAST(coalesce(nullif(thread_count, 0), 1) AS DOUBLE) * 10.0, 50.0) AS thread_score"
                          " FROM signals WHERE source = 'REACTIVE'"),
        "round2": A(f"SELECT id, {d.round2(SEVERITY_POINT)} AS point_severity FROM signals WHERE source = 'REACTIVE'"),
        "signal_type": A(f"SELECT theme_id, {SIGNAL_TYPE} AS signal_type FROM scores"),
        "evidence_summary": A(f"SELECT theme_id, {EVIDENCE} AS evidence_summary FROM scores"),
        "quote_text": A("SELECT id, quote FROM signals"),
        "detail_projection": AQ("WITH_QUOTES" + THEMES_VIEW_STANDARD),
        # jobs
        "synthesize_feedback": AQ("WITH_QUOTES" + THEMES_VIEW_SUMMARY),
        "product_plan": AQ("WITH_QUOTES" + PLAN_PRIORITIES),
        "feature_requests": fr_sql,
        "feature_request_comments": (
            f"WITH {d.POSTS_RAW}, {d.COMMENTS}, cm AS (SELECT c.*, p.portal FROM comments c JOIN posts_raw p ON p.id = c.post_id"
            f" WHERE lower(p.status) = 'open') SELECT portal, CAST(post_id AS BIGINT) AS post_id, CAST(pos AS BIGINT) AS pos,"
            f" role, comment_s AS comment, array_to_string(list_sort(comment_s_pii), '|') AS pii"
            f" FROM {d.scrub_from('cm', [('comment', 'comment_s')])}"),
        "pii_audit": A("SELECT CASE WHEN source = 'REACTIVE' THEN 'support_tickets' ELSE 'feature_votes' END AS source,"
                       " category, CAST(count(*) AS BIGINT) AS signals FROM (SELECT source, unnest(pii) AS category"
                       " FROM signals) GROUP BY ALL"),
    }
    return q


ORACLE = build()
