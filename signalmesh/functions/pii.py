"""PII redaction (X1-X7) as Catalyst column expressions -- no Python UDF.

Semantics follow the source regex dialect:
* ``\\s`` there includes the Unicode spaces, Java's does not -> explicit class.
* ``\\b`` there is ASCII; Java 17's is Unicode-aware -> explicit boundary.
* The card rule keeps a match only when its digits pass the Luhn check; Spark's
  ``regexp_extract_all`` + ``split`` with the same look-around pattern reproduce
  the left-to-right scan, and ``luhn_check`` is built in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Whitespace set of the source dialect's \s (WhiteSpace and
# LineTerminator code points) and its ASCII word-character set.
# (code points; ranges as pairs)
WS_CODES = (0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0xA0, 0x1680, (0x2000, 0x200A), 0x2028, 0x2029, 0x202F,
            0x205F, 0x3000, 0xFEFF)


def char_class_body(codes) -> str:
    """Character-class body with \\x{..} escapes (valid in Java and RE2)."""
    def esc(cp: int) -> str:
        return "\\x{%04x}" % cp
    return "".join(esc(c) if isinstance(c, int) else f"{esc(c[0])}-{esc(c[1])}" for c in codes)


WS = char_class_body(WS_CODES)
WORD = r"A-Za-z0-9_"
B = rf"(?:(?<=[{WORD}])(?![{WORD}])|(?<![{WORD}])(?=[{WORD}]))"
# Where the neighbouring pattern character is known to be a word character, the
# boundary reduces to a one-sided test (same matches, cheaper to evaluate).
B_BEFORE_WORD = rf"(?<![{WORD}])"
B_AFTER_WORD = rf"(?![{WORD}])"

# The four redaction patterns, in application order, with their
# placeholders and category names.
SSN_RE = rf"{B_BEFORE_WORD}\d{{3}}[-{WS}]\d{{2}}[-{WS}]\d{{4}}{B_AFTER_WORD}"
CARD_RE = rf"(?<!\d)(?:\d[-{WS}]?){{12,18}}\d(?!\d)"
EMAIL_RE = rf"{B}[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{{2,}}{B_AFTER_WORD}"
PHONE_RE = rf"(?:\+?1[-.{WS}]?)?\(?\d{{3}}\)?[-.{WS}]?\d{{3}}[-.{WS}]?\d{{4}}{B_AFTER_WORD}"

SSN_TAG = "[SSN REDACTED]"
CARD_TAG = "[CC REDACTED]"
EMAIL_TAG = "[EMAIL REDACTED]"
PHONE_TAG = "[PHONE REDACTED]"
CATEGORIES = ("ssn", "credit_card", "email", "phone")


def redact_ssn(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(SSN_RE), F.lit(SSN_TAG))


def card_matches(c: Column) -> Column:
    """All card-pattern matches of ``c`` in scan order."""
    return F.regexp_extract_all(c, F.lit(CARD_RE), 0)


def card_valid(matches: Column) -> Column:
    """Per match: are its 13-19 digits Luhn-valid?"""
    return F.transform(matches, lambda m: F.call_function("luhn_check", F.regexp_replace(m, r"[^0-9]", "")))


def redact_cards(c: Column) -> Column:
    """Replace Luhn-valid card matches; invalid ones stay verbatim.

    The text between matches comes from ``split`` on the same pattern, so the
    pieces and the matches interleave exactly.  Only rows with a candidate pay
    for the split.
    """
    matches = card_matches(c)
    valid = card_valid(matches)
    repl = F.zip_with(matches, valid, lambda m, ok: F.when(ok, F.lit(CARD_TAG)).otherwise(m))
    pieces = F.split(c, CARD_RE, -1)
    joined = F.array_join(F.zip_with(pieces, repl, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(c.rlike(CARD_RE), joined).otherwise(c)


def card_found(c: Column) -> Column:
    """True iff at least one card match of ``c`` would be redacted."""
    return F.when(c.rlike(CARD_RE), F.exists(card_valid(card_matches(c)), lambda v: v)).otherwise(F.lit(False))


def redact_email(c: Column) -> Column:
    # no "@" -> no match: skip the regex pass
    return F.when(F.instr(c, "@") > 0, F.regexp_replace(c, F.lit(EMAIL_RE), F.lit(EMAIL_TAG))).otherwise(c)


def redact_phone(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(PHONE_RE), F.lit(PHONE_TAG))


def _categories(s0: Column, s1: Column, card_hit: Column, s2: Column, s3: Column, s4: Column) -> Column:
    return F.filter(
        F.array(
            F.when(s1 != s0, F.lit("ssn")),
            F.when(card_hit, F.lit("credit_card")),
            F.when(s3 != s2, F.lit("email")),
            F.when(s4 != s3, F.lit("phone")),
        ),
        lambda x: x.isNotNull(),
    )


def _once(c: Column, use) -> Column:
    """``use(c)`` with ``c`` evaluated once, however often ``use`` names it: a name bound within an expression."""
    return F.get(F.transform(F.array(c), use), 0)


def _cards(s: Column) -> Column:
    """``struct(text, hit)`` of the card step."""
    def redacted(m: Column, valid: Column) -> Column:
        repl = F.zip_with(m, valid, lambda x, ok: F.when(ok, F.lit(CARD_TAG)).otherwise(x))
        joined = F.array_join(F.zip_with(F.split(s, CARD_RE, -1), repl, lambda a, r: F.concat(a, F.coalesce(r, F.lit("")))), "")
        return F.struct(joined.alias("text"), F.coalesce(F.exists(valid, lambda x: x), F.lit(False)).alias("hit"))

    some = _once(card_matches(s), lambda m: _once(card_valid(m), lambda valid: redacted(m, valid)))
    return F.when(s.rlike(CARD_RE), some).otherwise(F.struct(s.alias("text"), F.lit(False).alias("hit")))


def scrub_expr(c: Column) -> Column:
    """X5+X6 as one expression: ``struct(text, pii)``, every regex pass once.

    Intended for lambda bodies (array elements).  For top-level columns use
    :func:`with_scrub`, which materialises each step as a column.
    """
    def done(s0: Column, s1: Column, cards: Column, s3: Column, s4: Column) -> Column:
        return F.struct(s4.alias("text"), _categories(s0, s1, cards["hit"], cards["text"], s3, s4).alias("pii"))

    return _once(F.coalesce(c, F.lit("")), lambda s0: _once(redact_ssn(s0), lambda s1: _once(_cards(s1), lambda cards: _once(
        redact_email(cards["text"]), lambda s3: _once(redact_phone(s3), lambda s4: done(s0, s1, cards, s3, s4))))))


def scrub_array_expr(arr: Column) -> Column:
    """Element-wise scrub; ``struct(texts, pii)`` with categories unioned."""
    scrubbed = F.transform(F.coalesce(arr, F.array().cast("array<string>")), scrub_expr)
    return _once(scrubbed, lambda all_: F.struct(
        F.transform(all_, lambda s: s["text"]).alias("texts"),
        F.array_distinct(F.flatten(F.transform(all_, lambda s: s["pii"]))).alias("pii"),
    ))


def with_scrub(df: DataFrame, src: str, text_out: str, pii_out: str) -> DataFrame:
    """Add the scrubbed text and its PII categories of column ``src``.

    Each step is its own projection; Catalyst does not inline an expensive
    expression that is referenced more than once, so every regex pass runs
    once per row.
    """
    p = f"__{text_out}"
    out = (
        df.withColumn(f"{p}0", F.coalesce(F.col(src), F.lit("")))
        .withColumn(f"{p}1", redact_ssn(F.col(f"{p}0")))
        .withColumn(f"{p}m", F.when(F.col(f"{p}1").rlike(CARD_RE), card_matches(F.col(f"{p}1"))))
        .withColumn(f"{p}v", card_valid(F.col(f"{p}m")))
    )
    m, v, s1 = F.col(f"{p}m"), F.col(f"{p}v"), F.col(f"{p}1")
    repl = F.zip_with(m, v, lambda x, ok: F.when(ok, F.lit(CARD_TAG)).otherwise(x))
    joined = F.array_join(
        F.zip_with(F.split(s1, CARD_RE, -1), repl, lambda a, r: F.concat(a, F.coalesce(r, F.lit("")))), ""
    )
    out = (
        out.withColumn(f"{p}2", F.when(m.isNull(), s1).otherwise(joined))
        .withColumn(f"{p}h", F.coalesce(F.exists(v, lambda x: x), F.lit(False)))
        .withColumn(f"{p}3", redact_email(F.col(f"{p}2")))
        .withColumn(f"{p}4", redact_phone(F.col(f"{p}3")))
    )
    cats = _categories(F.col(f"{p}0"), F.col(f"{p}1"), F.col(f"{p}h"), F.col(f"{p}2"), F.col(f"{p}3"),
                       F.col(f"{p}4"))
    out = out.withColumn(pii_out, cats).withColumn(text_out, F.col(f"{p}4"))
    return out.drop(*[f"{p}{s}" for s in ("0", "1", "m", "v", "2", "h", "3", "4")])
