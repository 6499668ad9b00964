"""Scrubbing golden rows (the reference's scrubber suite) plus cases it lacks."""

from pyspark.sql import functions as F

from signalmesh.functions import pii

CASES = [
    ("My SSN is 123-45-6789, please update", "My SSN is [SSN REDACTED], please update", ["ssn"]),
    ("ssn: 123 45 6789", "ssn: [SSN REDACTED]", ["ssn"]),
    ("Order number 123456789 was placed", "Order number 123456789 was placed", []),
    ("Card 4111-1111-1111-1111 was charged", "Card [CC REDACTED] was charged", ["credit_card"]),
    ("Card 4111 1111 1111 1111 expired", "Card [CC REDACTED] expired", ["credit_card"]),
    ("amex 3782-822463-10005", "amex [CC REDACTED]", ["credit_card"]),
    ("Contact me at john.doe@example.com please", "Contact me at [EMAIL REDACTED] please", ["email"]),
    ("user+tag@subdomain.example.co.uk", "[EMAIL REDACTED]", ["email"]),
    ("from a@b.com to c@d.org", "from [EMAIL REDACTED] to [EMAIL REDACTED]", ["email"]),
    ("Visit example.com for details", "Visit example.com for details", []),
    ("Call me at +1 (555) 123-4567", "Call me at [PHONE REDACTED]", ["phone"]),
    ("phone: 555-123-4567", "phone: [PHONE REDACTED]", ["phone"]),
    ("text 5551234567 now", "text [PHONE REDACTED] now", ["phone"]),
    ("The booking system is broken when I click submit.", "The booking system is broken when I click submit.", []),
    ("", "", []),
    # not in the reference suite
    ("x 123 45 6789 y", "x [SSN REDACTED] y", ["ssn"]),
    ("pay 4111 1111 1111 1111 4111 1111 1111 1111 ok", "pay [CC REDACTED] [CC REDACTED] ok", ["credit_card"]),
    # a 23-digit run is no card; the phone rule has no left boundary and takes its last 11 digits
    ("id 41111111111111111111111 end", "id 411111111111[PHONE REDACTED] end", ["phone"]),
]


def _run(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    a = df.select(pii.scrub_expr(F.col("t")).alias("s")).collect()
    b = pii.with_scrub(df, "t", "st", "sp").collect()
    return [(x.s.text, list(x.s.pii), y.st, list(y.sp)) for x, y in zip(a, b)]


def test_golden_rows(spark):
    got = _run(spark, [c[0] for c in CASES])
    for (src, want_text, want_cats), (t1, c1, t2, c2) in zip(CASES, got):
        assert t1 == want_text, src
        assert c1 == want_cats, src
        assert (t2, c2) == (t1, c1), src


def test_luhn_failure_keeps_digits(spark):
    [(text, cats, _, _)] = _run(spark, ["not a card 1234-5678-9012-3456 just digits"])
    assert "[CC REDACTED]" not in text
    assert "credit_card" not in cats


def test_all_four_categories(spark):
    [(text, cats, _, _)] = _run(spark, [
        "I'm john@example.com, ssn 123-45-6789, card 4111-1111-1111-1111, phone 555-123-4567"])
    assert set(cats) == {"ssn", "credit_card", "email", "phone"}
    for tag in ("[EMAIL REDACTED]", "[SSN REDACTED]", "[CC REDACTED]", "[PHONE REDACTED]"):
        assert tag in text


def test_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    r = df.select(pii.scrub_expr(F.col("t")).alias("s")).first()
    assert r.s.text == "" and list(r.s.pii) == []


def test_scrub_array(spark):
    df = spark.createDataFrame([(["email me at a@b.com", "no pii here", "card 4111-1111-1111-1111"],)],
                               "a array<string>")
    r = df.select(pii.scrub_array_expr(F.col("a")).alias("s")).first()
    assert list(r.s.texts) == ["email me at [EMAIL REDACTED]", "no pii here", "card [CC REDACTED]"]
    assert set(r.s.pii) == {"email", "credit_card"}


def test_array_scrub_runs_every_pattern_once(spark):
    lines = ["ssn 123-45-6789", "card 4111 1111 1111 1111 a@b.co", None, "", "card 4111 1111 1111 1112", "call 415-555-0123, 078-05-1120"]
    df = spark.createDataFrame([(lines,), (None,), ([],)], "a array<string>")
    out = df.select(pii.scrub_array_expr(F.col("a")).alias("s")).select(F.col("s.texts").alias("t"), F.col("s.pii").alias("p"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert max(plan.count(tag) for tag in (pii.SSN_TAG, pii.EMAIL_TAG, pii.PHONE_TAG)) <= 2  # a projection for each field at most
    each = pii.with_scrub(df.select(F.monotonically_increasing_id().alias("i"), F.explode("a").alias("l")), "l", "t", "p").collect()
    got = out.collect()
    assert got[0].t == [r.t for r in each] and set(got[0].p) == {c for r in each for c in r.p} == set(pii.CATEGORIES)
    assert [(r.t, r.p) for r in got[1:]] == [([], []), ([], [])]
