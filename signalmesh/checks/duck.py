"""DuckDB SQL builders for the correctness oracle.

Independent re-statements of the operators in DuckDB's dialect (RE2 regexes,
list lambdas), written against the same driver tables.  RE2 has no
look-around, so the card rule's left-to-right scan is re-derived on digit
chains with ``list_reduce`` (a chain = digits joined by single separators;
from each run start the scan takes the longest 13-19-digit prefix ending at a
run end; otherwise it moves to the next run).
"""

from __future__ import annotations

from signalmesh.config import FIXTURE_THEMES, ThemesConfig
from signalmesh.functions.pii import WS
from signalmesh.functions.scoring import TAG_BOOST
from signalmesh.functions.text import AGENT_PATTERNS, escape_regex, split_keywords

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


# RE2 forms: \b is ASCII there, so the plain boundary is the source's boundary.
SSN = rf"\b\d{{3}}[-{WS}]\d{{2}}[-{WS}]\d{{4}}\b"
EMAIL = rf"\b[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}\b"
PHONE = rf"(?:\+?1[-.{WS}]?)?\(?\d{{3}}\)?[-.{WS}]?\d{{3}}[-.{WS}]?\d{{4}}\b"
CHAIN = rf"[0-9](?:[-{WS}]?[0-9])*"
DOT = r"[^\n\r\x{2028}\x{2029}]"
AGENT = "(?i)(?:" + "|".join(p.replace(".", DOT) if ".*" in p else p for p in AGENT_PATTERNS) + ")"


def luhn(d: str) -> str:
    dig = f"CAST(substr({d}, length({d}) - lz, 1) AS INTEGER)"
    term = f"CASE WHEN lz % 2 = 1 THEN (CASE WHEN {dig} * 2 > 9 THEN {dig} * 2 - 9 ELSE {dig} * 2 END) ELSE {dig} END"
    return f"(list_sum(list_transform(range(length({d})), lambda lz: {term})) % 10 = 0)"


def _digits(w: str) -> str:
    return f"array_to_string(list_transform({w}, lambda wq_: wq_.d), '')"


def _plain(w: str) -> str:
    return f"array_to_string(list_transform({w}, lambda wq_: wq_.d || wq_.s), '')"


def _match(w: str) -> str:
    return f"(CASE WHEN {luhn(_digits(w))} THEN '[CC REDACTED]' || {w}[-1].s ELSE {_plain(w)} END)"


def card_walk(c: str) -> str:
    """struct(t, h) for one digit chain ``c``: rewritten text, any card redacted."""
    runs = f"regexp_extract_all({c}, '[0-9]+')"
    elems = (f"list_transform({runs}, lambda d, i: {{'d': d, "
             f"'s': coalesce(regexp_extract_all({c}, '[^0-9]')[i], '')}})")
    L = "length(e.d)"
    t = ("list_filter(range(1, len(acc.w) + 1), lambda k: acc.n - list_sum(list_transform(acc.w[1:k], "
         f"lambda lq_: length(lq_.d))) + {L} <= 19)[1]")
    step = (
        f"CASE WHEN acc.n + {L} <= 19 THEN {{'o': acc.o, 'w': list_append(acc.w, e), 'n': acc.n + {L}, 'h': acc.h}}"
        f" WHEN acc.n >= 13 AND {L} <= 19 THEN {{'o': acc.o || {_match('acc.w')}, 'w': [e], 'n': {L},"
        f" 'h': acc.h OR {luhn(_digits('acc.w'))}}}"
        f" WHEN acc.n >= 13 THEN {{'o': acc.o || {_match('acc.w')} || e.d || e.s, 'w': acc.w[1:0], 'n': 0::BIGINT,"
        f" 'h': acc.h OR {luhn(_digits('acc.w'))}}}"
        f" WHEN {L} > 19 THEN {{'o': acc.o || {_plain('acc.w')} || e.d || e.s, 'w': acc.w[1:0], 'n': 0::BIGINT,"
        f" 'h': acc.h}}"
        f" ELSE list_transform([{t}], lambda t: {{'o': acc.o || {_plain('acc.w[1:t]')},"
        f" 'w': list_append(acc.w[t + 1:], e),"
        f" 'n': acc.n - list_sum(list_transform(acc.w[1:t], lambda lq_: length(lq_.d))) + {L}, 'h': acc.h}})[1] END"
    )
    init = "{'o': '', 'w': []::STRUCT(d VARCHAR, s VARCHAR)[], 'n': 0::BIGINT, 'h': false}"
    red = f"list_reduce({elems}, lambda acc, e: {step}, {init})"
    fin = (f"list_transform([{red}], lambda r: {{'t': r.o || CASE WHEN r.n >= 13 THEN {_match('r.w')} "
           f"ELSE {_plain('r.w')} END, 'h': r.h OR (r.n >= 13 AND {luhn(_digits('r.w'))})}})[1]")
    short = f"length(regexp_replace({c}, '[^0-9]', '', 'g')) < 13"
    return f"(CASE WHEN {short} THEN {{'t': {c}, 'h': false}} ELSE {fin} END)"


def card_redact(x: str) -> str:
    """struct(t, h) for a whole text ``x``."""
    chains = f"regexp_extract_all({x}, {lit(CHAIN)})"
    pieces = f"regexp_split_to_array({x}, {lit(CHAIN)})"
    walked = f"list_transform({chains}, lambda c: {card_walk('c')})"
    body = (f"list_transform([{walked}], lambda wk: {{'t': {pieces}[1] || array_to_string(list_transform(wk, "
            f"lambda w, i: w.t || {pieces}[i + 1]), ''), 'h': len(list_filter(wk, lambda w: w.h)) > 0}})[1]")
    return f"(CASE WHEN regexp_matches({x}, '[0-9](?:[-{WS}]?[0-9]){{12}}') THEN {body} ELSE {{'t': {x}, 'h': false}} END)"


def scrub_from(source: str, fields: list[tuple[str, str]]) -> str:
    """``SELECT *`` over ``source`` plus, per ``(src, name)``, the scrubbed
    ``name`` and its categories ``name_pii``; one subquery level per step so
    every pass runs once per row."""
    q = f"(SELECT * FROM {source})"
    steps = [
        lambda s, n: f"coalesce({s}, '') AS {n}__0",
        lambda s, n: f"regexp_replace({n}__0, {lit(SSN)}, '[SSN REDACTED]', 'g') AS {n}__1",
        lambda s, n: f"{card_redact(n + '__1')} AS {n}__c",
        lambda s, n: f"struct_extract({n}__c, 't') AS {n}__2, struct_extract({n}__c, 'h') AS {n}__h",
        lambda s, n: (f"CASE WHEN position('@' IN {n}__2) > 0 THEN regexp_replace({n}__2, {lit(EMAIL)},"
                      f" '[EMAIL REDACTED]', 'g') ELSE {n}__2 END AS {n}__3"),
        lambda s, n: f"regexp_replace({n}__3, {lit(PHONE)}, '[PHONE REDACTED]', 'g') AS {n}",
        lambda s, n: (f"list_filter([CASE WHEN {n}__1 <> {n}__0 THEN 'ssn' END, CASE WHEN {n}__h THEN 'credit_card' END,"
                      f" CASE WHEN {n}__3 <> {n}__2 THEN 'email' END, CASE WHEN {n} <> {n}__3 THEN 'phone' END],"
                      f" lambda nn_: nn_ IS NOT NULL) AS {n}_pii"),
    ]
    for step in steps:
        q = f"(SELECT *, {', '.join(step(src, name) for src, name in fields)} FROM {q})"
    return q


def scrub_expr(x: str) -> str:
    """Single-expression scrub -> struct(text, pii) (for lambda bodies)."""
    s1 = f"regexp_replace(coalesce({x}, ''), {lit(SSN)}, '[SSN REDACTED]', 'g')"
    return (f"list_transform([{{'s0': coalesce({x}, ''), 's1': {s1}}}], lambda a: list_transform([{card_redact('a.s1')}],"
            f" lambda c: list_transform([{{'s2': c.t, 's3': regexp_replace(c.t, {lit(EMAIL)}, '[EMAIL REDACTED]', 'g')}}],"
            f" lambda b: list_transform([regexp_replace(b.s3, {lit(PHONE)}, '[PHONE REDACTED]', 'g')], lambda s4:"
            f" {{'text': s4, 'pii': list_filter([CASE WHEN a.s1 <> a.s0 THEN 'ssn' END, CASE WHEN c.h THEN 'credit_card' END,"
            f" CASE WHEN b.s3 <> b.s2 THEN 'email' END, CASE WHEN s4 <> b.s3 THEN 'phone' END], lambda nn_: nn_ IS NOT NULL)}})[1])[1])[1])[1]")


def agent(x: str) -> str:
    return f"(coalesce({x}, '') = '' OR regexp_matches({x}, {lit(AGENT)}))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '[{WS}]+', ' ', 'g'), ' ')"


def cut200(x: str) -> str:
    return f"(CASE WHEN length({x}) > 200 THEN substr({x}, 1, 197) || '...' ELSE {x} END)"


def keyword_pred(text: str, keywords) -> str:
    phrases, words = split_keywords(keywords)
    preds = [f"contains({text}, {lit(p)})" for p in phrases]
    preds += [f"regexp_matches({text}, {lit(chr(92) + 'b' + escape_regex(w) + chr(92) + 'b')})" for w in words]
    return "(" + " OR ".join(preds) + ")" if preds else "false"


def theme_array(text: str, cfg: ThemesConfig) -> str:
    items = ", ".join(f"CASE WHEN {keyword_pred(text, t.keywords)} THEN {i} END" for i, t in enumerate(cfg.themes))
    return f"list_filter([{items}], lambda nn_: nn_ IS NOT NULL)"


def themes_values(cfg: ThemesConfig) -> str:
    rows = ", ".join(f"({i}, {lit(t.id)}, {lit(t.label)}, {lit(t.category)})" for i, t in enumerate(cfg.themes))
    return f"(VALUES {rows}) AS v(theme_idx, theme_id, label, category)"


def stops_list(cfg: ThemesConfig) -> str:
    return "[" + ", ".join(lit(w) for w in cfg.stop_words) + "]"


def tokens(text: str, cfg: ThemesConfig) -> str:
    cleaned = f"regexp_replace({text}, '(?i)\\[(?:ssn|cc|email|phone) redacted\\]', ' ', 'g')"
    return (f"list_filter(regexp_extract_all({cleaned}, '[a-z0-9]+'), lambda w: length(w) > 2 AND NOT "
            f"list_contains({stops_list(cfg)}, w))")


def ngrams(toks: str) -> str:
    bi = f"list_transform(range(1, len({toks})), lambda i: {toks}[i] || ' ' || {toks}[i + 1])"
    tri = f"list_transform(range(1, len({toks}) - 1), lambda i: {toks}[i] || ' ' || {toks}[i + 1] || ' ' || {toks}[i + 2])"
    return f"list_concat({bi}, {tri})"


def tag_boost(tags: str) -> str:
    cases = " ".join(f"WHEN {lit(k)} THEN {v}" for k, v in TAG_BOOST.items())
    return (f"CAST(coalesce(list_filter(list_transform(coalesce({tags}, []::VARCHAR[]), lambda t: CASE lower(t) {cases} END),"
            f" lambda b: b IS NOT NULL)[1], 0) AS DOUBLE)")


def round2(x: str) -> str:
    return f"(floor(CAST({x} AS DOUBLE) * 100.0 + 0.5) / 100.0)"


# ----------------------------------------------------------------------------
# Fixture CTEs (FIXTURES.md B1/B2 with whole texts)
# ----------------------------------------------------------------------------

TICKETS_RAW = f"""tickets_raw AS (
  SELECT doc_id AS id, split_part(text, chr(10), 1) AS subject, text AS preview, doc_id % 5 AS mailbox_id,
         {AS_OF} - to_minutes(CAST((doc_id * 7919) % 86400 AS INTEGER)) AS created_at,
         CASE WHEN doc_id % 7 = 0 THEN ['Bug', 'urgent'] WHEN doc_id % 11 = 0 THEN ['vip', 'Escalation']
              ELSE []::VARCHAR[] END AS tags,
         CAST(doc_id % 8 AS INTEGER) AS threads
  FROM documents)"""

POSTS_RAW = f"""posts_raw AS (
  SELECT conv_id AS id,
         arg_min(text, turn) FILTER (WHERE role = 'user') AS title,
         coalesce(arg_min(text, turn) FILTER (WHERE role = 'assistant'), '') AS description,
         'portal_' || CAST(conv_id % 3 AS VARCHAR) AS portal,
         CASE conv_id % 4 WHEN 0 THEN 'Open' WHEN 1 THEN 'Planned' WHEN 2 THEN 'Completed' END AS status,
         (conv_id * 37) % 101 AS votes_count,
         count(*) FILTER (WHERE turn > 0) AS comments_count,
         {AS_OF} - to_minutes(CAST((conv_id * 7919) % 172800 AS INTEGER)) AS created_at,
         conv_id AS feed_seq
  FROM conversations GROUP BY conv_id)"""

COMMENTS = """comments AS (
  SELECT conv_id AS post_id, turn AS pos, CASE role WHEN 'assistant' THEN 'admin' ELSE 'user' END AS role,
         text AS comment
  FROM conversations WHERE turn > 0)"""


def window_lo(days: int = 30) -> str:
    return f"({AS_OF} - INTERVAL {int(days)} DAY)"


def tickets_win(days: int = 30, mailbox_id: int | None = None) -> str:
    mb = f" AND mailbox_id = {int(mailbox_id)}" if mailbox_id is not None else ""
    return (f"tickets_win AS (SELECT * FROM tickets_raw WHERE created_at BETWEEN {window_lo(days)} AND {AS_OF}{mb})")


TICKETS_CLEAN = ("tickets_clean AS (SELECT id, mailbox_id, created_at, tags, CAST(threads AS INTEGER) AS thread_count, "
                 "subject_s, preview_s, CASE WHEN coalesce(preview, '') <> '' THEN [preview_s] ELSE []::VARCHAR[] END"
                 " AS messages, list_sort(list_distinct(list_concat(subject_s_pii, preview_s_pii))) AS pii FROM "
                 + scrub_from("tickets_win", [("subject", "subject_s"), ("preview", "preview_s")]) + ")")


def posts_sel(days: int = 30, limit: int = 50, portal: str | None = None) -> str:
    pf = f"WHERE lower(portal) = lower({lit(portal)})" if portal else ""
    return f"""posts_f AS (SELECT * FROM posts_raw {pf}),
posts_recent AS (
  SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY portal, id ORDER BY feed_seq) AS r
                             FROM posts_f WHERE created_at >= {window_lo(days)}) WHERE r = 1),
posts_top AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY portal ORDER BY coalesce(votes_count, 0) DESC, feed_seq)
                   AS vote_rank FROM posts_f) WHERE vote_rank <= {int(limit)}),
posts_sel AS (
  SELECT * EXCLUDE (vote_rank), 0 AS grp, feed_seq AS k1, 0 AS k2 FROM (SELECT *, NULL AS vote_rank FROM posts_recent)
  UNION ALL
  SELECT * EXCLUDE (vote_rank), 1 AS grp, -coalesce(votes_count, 0) AS k1, feed_seq AS k2 FROM posts_top t
  WHERE NOT EXISTS (SELECT 1 FROM posts_recent r WHERE r.portal = t.portal AND r.id = t.id))"""


REQUESTS_CLEAN = ("requests_clean AS (SELECT id, portal, status, votes_count, comments_count, created_at, grp, k1, k2, "
                  "title_s, desc_s, list_sort(list_distinct(list_concat(title_s_pii, desc_s_pii))) AS pii FROM "
                  + scrub_from("posts_sel", [("title", "title_s"), ("description", "desc_s")]) + ")")

TICKET_QUOTE = (
    "CASE WHEN {m} <> '' AND NOT {am} THEN '[Support ticket] \"' || {cm} || '\"' "
    "WHEN coalesce(subject_s, '') <> '' AND NOT {asub} THEN '[Support ticket] \"' || subject_s || '\"' END"
)


def _ticket_quote() -> str:
    m = collapse("coalesce(messages[1], '')")
    return TICKET_QUOTE.format(m=m, am=agent(m), cm=cut200(m), asub=agent("subject_s"))


def signals(cfg: ThemesConfig) -> str:
    return f"""signals AS (
  SELECT 'hs-' || CAST(id AS VARCHAR) AS id, 'REACTIVE' AS source, subject_s AS title,
         lower(array_to_string(list_concat([subject_s, preview_s], messages), ' ')) AS text,
         created_at, tags, thread_count, CAST(NULL AS BIGINT) AS votes, CAST(NULL AS BIGINT) AS comments_count,
         CAST(NULL AS VARCHAR) AS portal,
         0 AS o_src, '' AS o_portal, 0 AS o_grp, -epoch_us(created_at) AS o_k1, CAST(id AS BIGINT) AS o_k2,
         {_ticket_quote()} AS quote, pii
  FROM tickets_clean
  UNION ALL
  SELECT 'pl-' || CAST(id AS VARCHAR), 'PROACTIVE', title_s, lower(concat_ws(' ', title_s, desc_s)),
         created_at, CAST(NULL AS VARCHAR[]), CAST(NULL AS INTEGER), CAST(votes_count AS BIGINT),
         CAST(comments_count AS BIGINT), portal,
         1, portal, grp, CAST(k1 AS BIGINT), CAST(k2 AS BIGINT),
         '[Feature request, ' || CAST(votes_count AS VARCHAR) || ' votes] "' || coalesce(title_s, '') || '"', pii
  FROM requests_clean),
tagged AS (SELECT *, {theme_array('text', cfg)} AS theme_idxs FROM signals),
points AS (SELECT * EXCLUDE (theme_idxs), unnest(theme_idxs) AS theme_idx FROM tagged),
themes AS (SELECT * FROM {themes_values(cfg)}),
unmatched AS (SELECT * FROM tagged t WHERE len(theme_idxs) = 0
              AND NOT EXISTS (SELECT 1 FROM tagged h WHERE len(h.theme_idxs) > 0 AND h.id = t.id))"""


def scores() -> str:
    sev = (f"(least(coalesce(nullif(thread_count, 0), 1) * 10.0, 50.0) + CASE WHEN created_at IS NULL THEN 0.0 ELSE "
           f"30.0 * exp(-(CASE WHEN date_diff('microsecond', created_at, {AS_OF}) < 0 THEN 0.0 ELSE "
           f"CAST(date_diff('microsecond', created_at, {AS_OF}) AS DOUBLE) / 86400000000.0 END) / 7.0) END"
           f" + {tag_boost('tags')})")
    return f"""agg AS (
  SELECT theme_idx, count(*) AS points,
         count(*) FILTER (WHERE source = 'REACTIVE') AS reactive_count,
         count(*) FILTER (WHERE source = 'PROACTIVE') AS proactive_count,
         sum(CASE WHEN source = 'REACTIVE' THEN {sev} END) AS sev_sum,
         CAST(coalesce(sum(CASE WHEN source = 'PROACTIVE' THEN coalesce(votes, 0) END), 0) AS DOUBLE) * 0.8
           + CAST(coalesce(sum(CASE WHEN source = 'PROACTIVE' THEN coalesce(comments_count, 0) END), 0) AS DOUBLE) * 0.2
           AS momentum_raw
  FROM points GROUP BY theme_idx),
mx AS (SELECT greatest(CAST(max(points) AS DOUBLE), 1.0) AS max_points, greatest(max(momentum_raw), 1.0) AS max_momentum
       FROM agg),
raw_scores AS (
  SELECT a.theme_idx, t.theme_id, t.label, t.category, CAST(a.reactive_count AS BIGINT) AS reactive_count,
         CAST(a.proactive_count AS BIGINT) AS proactive_count, CAST(a.points AS BIGINT) AS points,
         (a.reactive_count > 0 AND a.proactive_count > 0) AS convergent,
         CAST(a.points AS DOUBLE) / mx.max_points * 100.0 AS f,
         CASE WHEN a.reactive_count > 0 THEN least(a.sev_sum / CAST(a.reactive_count AS DOUBLE), 100.0) ELSE 0.0 END AS s,
         a.momentum_raw / mx.max_momentum * 100.0 AS v
  FROM agg a CROSS JOIN mx JOIN themes t ON t.theme_idx = a.theme_idx),
scores AS (
  SELECT theme_idx, theme_id, label, category, reactive_count, proactive_count, points, convergent,
         {round2('f')} AS frequency_score, {round2('s')} AS severity_score, {round2('v')} AS vote_momentum_score,
         {round2('(f * 0.35 + s * 0.35 + v * 0.3) * CASE WHEN convergent THEN 2.0 ELSE 1.0 END')} AS priority_score
  FROM raw_scores),
ranked AS (SELECT *, CAST(row_number() OVER (ORDER BY priority_score DESC, theme_idx) AS BIGINT) AS rank FROM scores)"""


def analysis_ctes(cfg: ThemesConfig = FIXTURE_THEMES, days: int = 30, limit: int = 50, portal: str | None = None,
                  mailbox_id: int | None = None) -> str:
    return ",\n".join([TICKETS_RAW, POSTS_RAW, COMMENTS, tickets_win(days, mailbox_id), TICKETS_CLEAN,
                       posts_sel(days, limit, portal), REQUESTS_CLEAN, signals(cfg), scores()])


def with_analysis(select: str, **kw) -> str:
    return "WITH " + analysis_ctes(**kw) + "\n" + select
