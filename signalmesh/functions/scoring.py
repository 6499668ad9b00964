"""Scoring scalars (X11-X16) as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from signalmesh.params import Weights

# Severity boost of the first matching tag (lower-cased).
TAG_BOOST = {"bug": 20, "urgent": 25, "escalation": 30, "escalated": 30, "critical": 25}

DAY_MICROS = 86_400_000_000.0


def age_days(created_at: Column, as_of: Column) -> Column:
    """Age in days; future dates clamp to 0; null (unparseable) stays null."""
    d = F.timestamp_diff("MICROSECOND", created_at, as_of).cast("double") / F.lit(DAY_MICROS)
    return F.when(d < 0, F.lit(0.0)).otherwise(d)


def recency_boost(created_at: Column, as_of: Column, w: Weights = Weights()) -> Column:
    """X11: peak * e^(-age/days); unparseable date -> 0 (age = infinity)."""
    a = age_days(created_at, as_of)
    return F.when(a.isNull(), F.lit(0.0)).otherwise(F.lit(w.recency_peak) * F.exp(-a / F.lit(w.recency_days)))


def tag_boost(tags: Column) -> Column:
    """Boost of the first tag (in array order) found in the table, else 0."""
    m = F.create_map(*[x for k, v in TAG_BOOST.items() for x in (F.lit(k), F.lit(v))])
    hits = F.filter(F.transform(F.coalesce(tags, F.array().cast("array<string>")),
                                lambda t: F.try_element_at(m, F.lower(t))), lambda b: b.isNotNull())
    return F.coalesce(F.get(hits, 0), F.lit(0)).cast("double")


def thread_score(threads: Column, w: Weights = Weights()) -> Column:
    """min((threads or 1) * unit, cap); 0 and null count as 1."""
    t = F.coalesce(F.nullif(threads.cast("bigint"), F.lit(0)), F.lit(1)).cast("double")
    return F.least(t * F.lit(w.thread_unit), F.lit(w.thread_cap))


def round2(x: Column) -> Column:
    """Half-up to 2 places on the double value (not decimal HALF_UP)."""
    return F.floor(x * F.lit(100.0) + F.lit(0.5)).cast("double") / F.lit(100.0)


def signal_type(convergent: Column, reactive_count: Column) -> Column:
    """Convergent / reactive / proactive."""
    return F.when(convergent, F.lit("convergent")).when(reactive_count > 0, F.lit("reactive")).otherwise(
        F.lit("proactive"))


def evidence_summary(reactive: Column, proactive: Column, convergent: Column) -> Column:
    """X16: "N signals (a support tickets, b feature requests)." (+ convergent note)."""
    parts = F.concat_ws(
        ", ",
        F.when(reactive > 0, F.concat(reactive.cast("string"), F.lit(" support tickets"))),
        F.when(proactive > 0, F.concat(proactive.cast("string"), F.lit(" feature requests"))),
    )
    base = F.concat((reactive + proactive).cast("string"), F.lit(" signals ("), parts, F.lit(")."))
    # Convergence sentence.
    note = " Convergent — appears in both support and feature requests (2x priority boost)."
    return F.when(convergent, F.concat(base, F.lit(note))).otherwise(base)


def js_number(x: Column) -> Column:
    """Render a double the way the source prints numbers (``100`` not ``100.0``)."""
    return F.regexp_replace(x.cast("string"), r"\.0$", "")
