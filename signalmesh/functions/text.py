"""Text column functions: keyword match (X8), tokenize (X9), n-grams (X10),
agent-text flag (F10), quote text (X17)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalmesh.functions.pii import WS, WORD

# Left/right ASCII word boundaries (the source dialect's \b is ASCII).
B_LEFT = rf"(?<![{WORD}])"
B_RIGHT = rf"(?![{WORD}])"

_META = re.compile(r"([.*+?^${}()|\[\]\\\-/])")


def escape_regex(s: str) -> str:
    """Escape regex metacharacters (valid for Java and RE2)."""
    return _META.sub(r"\\\1", s)


def split_keywords(keywords) -> tuple[list[str], list[str]]:
    """Keywords with a space match as plain substrings, others as whole words."""
    phrases = [k.lower() for k in keywords if " " in k]
    words = [k.lower() for k in keywords if " " not in k]
    return phrases, words


def word_pattern(words: list[str]) -> str:
    """One alternation of whole-word keywords (existence = OR of the words)."""
    return B_LEFT + "(?:" + "|".join(escape_regex(w) for w in words) + ")" + B_RIGHT


def keyword_match(text: Column, keywords) -> Column:
    """Does lower-cased ``text`` hit any keyword?  Empty list -> false.

    ``text`` is expected lower-case already (signal text is); keywords are
    lower-cased here, so the case-insensitive word test is a plain match.
    A whole-word hit implies a substring hit, so each word regex runs only
    behind a cheap ``contains`` test (rare keywords cost one byte scan).
    """
    phrases, words = split_keywords(keywords)
    preds = [text.contains(p) for p in phrases]
    preds += [text.contains(w) & text.rlike(word_pattern([w])) for w in words]
    if not preds:
        return F.lit(False)
    out = preds[0]
    for p in preds[1:]:
        out = out | p
    return F.coalesce(out, F.lit(False))


# Redaction placeholders dropped before tokenizing.
PLACEHOLDER_RE = r"(?i)\[(?:ssn|cc|email|phone) redacted\]"


def tokens(text: Column, stop_words) -> Column:
    """Placeholders out, maximal ``[a-z0-9]`` runs, length > 2, no stop words.

    Replacing every other character by a space and splitting on whitespace
    yields exactly the maximal runs of ``[a-z0-9]``.
    """
    cleaned = F.regexp_replace(text, PLACEHOLDER_RE, " ")
    runs = F.regexp_extract_all(cleaned, F.lit("[a-z0-9]+"), 0)
    stops = list(stop_words)
    if stops:
        return F.filter(runs, lambda w: (F.length(w) > 2) & ~w.isin(stops))
    return F.filter(runs, lambda w: F.length(w) > 2)


def ngrams(toks: Column) -> Column:
    """All bigrams, then all trigrams, in token order."""
    n = F.size(toks)
    bi = F.transform(F.slice(toks, 1, F.greatest(n - 1, F.lit(0))),
                     lambda w, i: F.concat_ws(" ", w, F.get(toks, i + 1)))
    tri = F.transform(F.slice(toks, 1, F.greatest(n - 2, F.lit(0))),
                      lambda w, i: F.concat_ws(" ", w, F.get(toks, i + 1), F.get(toks, i + 2)))
    return F.concat(bi, tri)


# Agent / automated-text patterns (case-insensitive), in order.
AGENT_PATTERNS = (
    r"happy to help",
    r"hope this helps",
    r"let me know if",
    r"don't hesitate",
    r"do not hesitate",
    r"feel free to",
    r"is there anything else",
    r"glad (to |you |we )",
    r"pleasure (to |helping)",
    r"(best|warm|kind) regards",
    r"i apologize for",
    r"we apologize for",
    r"sorry for the inconvenience",
    r"thank you for (reaching|contacting|writing|your patience)",
    r"thanks for (reaching|contacting|writing|your patience)",
    r"thanks (so much )?for checking in",
    r"bringing this to our attention",
    r"i've (checked|looked into|forwarded|sent|updated|resolved|fixed|escalated)",
    r"we've (identified|checked|looked|resolved|fixed|addressed|updated|escalated)",
    r"has been (resolved|fixed|addressed|updated|escalated)",
    r"this has been flagged",
    r"our (team|support|engineering|developers)",
    r"i can help with that",
    r"ai-generated draft",
    r"your request .* could(n't| not) be created",
    r"powered by",
    r"we're aiming to .* get back to you",
    r"before i proceed",
)

# "." in the source dialect excludes exactly these line terminators.
DOT = r"[^\n\r\x{2028}\x{2029}]"


def agent_regex(dot: str = DOT) -> str:
    return "(?:" + "|".join(p.replace(".", dot) if ".*" in p else p for p in AGENT_PATTERNS) + ")"


AGENT_RE = "(?i)" + agent_regex()


def is_agent_text(text: Column) -> Column:
    """empty/null text, or any agent pattern."""
    return F.coalesce(text, F.lit("")).eqNullSafe("") | F.coalesce(text.rlike(AGENT_RE), F.lit(False))


def collapse_ws(text: Column) -> Column:
    """Whitespace runs -> one space, then trim (only spaces remain to trim); a single space is left as it is."""
    return F.trim(F.regexp_replace(text, f"[{WS}]{{2,}}|[{WS}&&[^ ]]", " "))


def cut200(text: Column) -> Column:
    # Quote length cap 200, cut to 197 characters plus "...".
    return F.when(F.length(text) > 200, F.concat(F.substring(text, 1, 197), F.lit("..."))).otherwise(text)


def ticket_quote(first_message: Column, subject: Column) -> Column:
    """X17, ticket side: collapsed first message, else subject, else null."""
    return collapsed_quote(collapse_ws(F.coalesce(first_message, F.lit(""))), subject)


def collapsed_quote(msg: Column, subject: Column) -> Column:
    """:func:`ticket_quote` of a message collapsed before (a column, so that it is collapsed once)."""
    subj = F.coalesce(subject, F.lit(""))
    return (
        F.when((msg != "") & ~is_agent_text(msg), F.concat(F.lit('[Support ticket] "'), cut200(msg), F.lit('"')))
        .when((subj != "") & ~is_agent_text(subj), F.concat(F.lit('[Support ticket] "'), subj, F.lit('"')))
    )


def request_quote_text(first_comment: Column, title: Column, votes: Column) -> Column:
    """X17, request side, given the first non-admin comment's text (or null)."""
    head = F.concat(F.lit("[Feature request, "), F.coalesce(votes, F.lit(0)).cast("string"), F.lit(' votes] "'))
    return (
        F.when(first_comment.isNotNull() & ~is_agent_text(first_comment),
               F.concat(head, cut200(collapse_ws(first_comment)), F.lit('"')))
        .otherwise(F.concat(head, F.coalesce(title, F.lit("")), F.lit('"')))
    )


def request_quote(comments: Column, title: Column, votes: Column) -> Column:
    """X17, request side: first non-admin comment unless agent text, else title."""
    first = F.get(F.filter(F.coalesce(comments, F.array().cast("array<struct<role:string,comment:string,created_at:string>>")),
                           lambda c: ~F.coalesce(c["role"] == "admin", F.lit(False))), 0)
    head = F.concat(F.lit("[Feature request, "), F.coalesce(votes, F.lit(0)).cast("string"), F.lit(' votes] "'))
    return (
        F.when(first.isNotNull() & ~is_agent_text(first["comment"]),
               F.concat(head, cut200(collapse_ws(F.coalesce(first["comment"], F.lit("")))), F.lit('"')))
        .otherwise(F.concat(head, F.coalesce(title, F.lit("")), F.lit('"')))
    )
