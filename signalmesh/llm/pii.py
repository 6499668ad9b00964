"""Operator 2: personal data by patterns, and by contexts bootstrapped from what the patterns find.

DataFrame functions only.  Base patterns (email, ip, card, phone) are scanned
with possessive or anchored forms of themselves, which match the same strings
without backtracking over long runs; a match's place is the running length of
the gaps and matches before it, a window over the document's matches.

Bootstrapping adds what the patterns miss:

1. *Candidates* are the runs of non-space characters that hold a digit or ``@``,
   and numbers written as several runs of digits (with dots, dashes, brackets)
   joined by single spaces, which are one candidate; the two words before one,
   whatever they belong to, are its lexical *pattern*, its core is the *instance*.
2. *Seeds* are candidates that a base span covers; the whole span is the
   instance, with the span's kind.
3. Over the graph of patterns and instances, rounds alternate: a pattern's
   confidence for a kind is the mean score of its distinct instances, provided
   ``SUPPORT`` of them are already believed; an instance's score is the
   noisy-or of the confidence of its patterns that reach ``TRUST``.  Seeds keep
   score 1.  Each round is two aggregations over distinct edges, written to the
   shared checkpoint folder.  Scores only grow; rounds end when a round adds no
   trusted pattern and no believed instance and leaves the scores as they were.
4. Instances that are no seeds but end at ``TRUST`` or more are reported
   wherever a trusted pattern precedes them, as kinds ``ctx_email``, ``ctx_ip``,
   ``ctx_card`` and ``ctx_phone``, if they are identifier-like (``@`` or four
   digits) and touch no base span.

So a number that fails its check digit is found after "card number" when many
valid ones are.  Texts are random enough elsewhere that no pattern of two words
gathers support, and clean documents are left alone.

Defined results: null text is empty; documents without findings have counts 0,
empty ``spans`` and the digest of the empty string; repeated rows are separate
documents; an empty table gives no rows.  Spans are in code points, end
exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from signalmesh.llm.common import RID, identified, table, written

KINDS = ("email", "ip", "card", "phone")
ADDED = tuple(f"ctx_{k}" for k in KINDS)
SUPPORT, TRUST = 3, 0.8
#: Rounds after which scores that still grow are an error, and the growth of their sum that counts as none.
ROUNDS, STILL = 100, 1e-6
#: Characters before a candidate in which its two words are looked for.
CONTEXT = 80

LOCAL = r"[A-Za-z0-9._%+-]"
#: kind -> (its pattern, a character that every match holds). The forms in the contract, made linear: a run that
#: must be whole is possessive, and a match begins where its run does or where the last match ended.
PATTERNS = {
    "email": (rf"(?:(?<!{LOCAL})|\G){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@"),
    "ip": (r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", "."),
    "card": (r"[0-9](?:[\x20-]?[0-9])++", None),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "+"),
}
PART = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"
#: Digits of one run, other than an address of four parts, which stays a candidate of its own.
NUMBER = r"(?![0-9]++(?:\.[0-9]++){3})[0-9](?:[().-]*+[0-9])*+\)?+"
CANDIDATE = rf"""(?<!\S)[^\s0-9@]*+(?:{NUMBER}(?:\x20\(?+{NUMBER}(?=[.,;:!?"'\]}}]*+(?:\s|$)))++|[0-9@]\S*+)"""


def _digits(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def _holds(kind: Column, m: Column) -> Column:
    card = F.regexp_replace(m, "[ -]", "")
    return (F.when(kind == "email", True)
            .when(kind == "ip", m.rlike(rf"^{PART}(?:\.{PART}){{3}}$"))
            .when(kind == "card", F.length(card).between(13, 19) & F.expr("luhn_check(regexp_replace(m, '[ -]', ''))"))
            .otherwise(F.length(_digits(m)).between(9, 15)))


def _matches(kind: str, pattern: str, marker: str | None) -> Column:
    """Gaps and matches of one pattern in order; nothing is scanned where no match can be."""
    text = F.col("text")
    # split keeps the gap after the last match too, so the two arrays differ by one entry, which has no match
    pairs = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"))
    if kind == "candidate":
        may = text.rlike("[0-9@]")
    else:
        may = text.rlike("[0-9]") if marker is None or kind in ("ip", "phone") else F.lit(True)
        if marker:
            may = F.contains(text, F.lit(marker)) & may
    return F.transform(F.when(may, pairs), lambda x: F.struct(F.lit(kind).alias("kind"), x["gap"].alias("gap"), x["m"].alias("m")))


def _placed(rows: DataFrame) -> DataFrame:
    """All matches of all patterns: row number, kind, match, start, end, and the text before a candidate."""
    kinds = {**PATTERNS, "candidate": (CANDIDATE, None)}
    arrays = [_matches(k, p, marker) for k, (p, marker) in kinds.items()]
    none = F.array().cast("array<struct<kind:string,gap:string,m:string>>")
    found = (rows.select(RID, F.explode(F.array(*[F.coalesce(a, none) for a in arrays])).alias("of_kind"))
             .select(RID, F.posexplode("of_kind").alias("at", "x")).filter("x.m is not null")
             .select(RID, "at", F.col("x.kind").alias("kind"), F.col("x.m").alias("m"), F.length("x.gap").cast("long").alias("gap"),
                     F.substring("x.gap", -CONTEXT, CONTEXT).alias("before")))
    in_order = Window.partitionBy(RID, "kind").orderBy("at")
    through = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a gap and a match have a character each at least
    earlier = in_order.rowsBetween(-(CONTEXT // 2), -1)
    piece = F.when(F.col("kind") == "candidate", F.concat("before", F.substring("m", -CONTEXT, CONTEXT)))
    size = F.length("m").cast("long")
    return (found.withColumn("end", F.sum(F.col("gap") + size).over(through)).withColumn("start", F.col("end") - size)
            .withColumn("context", F.substring(F.concat(F.array_join(F.collect_list(piece).over(earlier), ""), F.col("before")), -CONTEXT, CONTEXT)))


def _edges(found: DataFrame) -> DataFrame:
    """Candidates with their pattern, instance and the kind of the base span that covers them, if any."""
    marked = found.filter((F.col("kind") == "candidate") | _holds(F.col("kind"), F.col("m")))
    base = F.col("kind") != "candidate"
    upto = Window.partitionBy(RID).orderBy("start", F.col("kind") == "candidate").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy(RID).orderBy("start", F.col("kind") == "candidate").rowsBetween(1, Window.unboundedFollowing)
    marked = (marked.withColumn("cover", F.max(F.when(base, F.struct(F.col("end").alias("to"), F.col("kind").alias("of"), F.col("m").alias("m")))).over(upto))
              .withColumn("next", F.min(F.when(base, F.struct(F.col("start").alias("from"), F.col("kind").alias("of"), F.col("m").alias("m")))).over(after)))
    lead = F.length(F.regexp_extract("m", r"^[^\p{L}\p{N}+(]*", 0))
    core = F.regexp_replace(F.regexp_replace("m", r"^[^\p{L}\p{N}+(]+", ""), r"[^\p{L}\p{N})]+$", "")
    words = F.regexp_extract_all(F.lower("context"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    return (marked.filter("kind = 'candidate'")
            .withColumn("instance", core).withColumn("from", F.col("start") + lead)
            .withColumn("to", F.col("from") + F.length("instance"))
            .withColumn("words", words).filter("size(words) >= 2 and instance <> ''")
            .withColumn("pattern", F.concat_ws(" ", F.slice("words", -2, 2)))
            .withColumn("base", F.when(F.col("cover.to") > F.col("from"), F.struct("cover.of", "cover.m"))
                        .when(F.col("next.from") < F.col("to"), F.struct("next.of", "next.m")))
            .select(RID, "pattern", F.coalesce("base.m", "instance").alias("instance"), "from", "to", F.col("base.of").alias("seed")))


def bootstrap(edges: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST) -> tuple[DataFrame, DataFrame]:
    """Trusted ``pattern, kind, confidence`` and believed ``instance, kind, score`` of the graph of ``edges``."""
    graph = written(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "pii-graph")
    seeds = graph.filter("seed is not null").groupBy("instance", F.col("seed").alias("kind")).agg(F.lit(1.0).alias("score"))
    size = graph.groupBy("pattern").agg(F.count("*").alias("instances"))
    scores = written(seeds, "pii-scores")
    last = None
    for _ in range(rounds):
        told = (graph.join(scores, "instance").groupBy("pattern", "kind")
                .agg(F.sum("score").alias("score"), F.sum(F.when(F.col("score") >= trust, 1).otherwise(0)).alias("believed")))
        patterns = written(told.filter(F.col("believed") >= support).join(size, "pattern")
                           .select("pattern", "kind", (F.col("score") / F.col("instances")).alias("confidence"))
                           .filter(F.col("confidence") >= trust), "pii-patterns")
        heard = (graph.join(patterns, "pattern").groupBy("instance", "kind")
                 .agg((1 - F.exp(F.sum(F.log1p(-F.least(F.col("confidence"), F.lit(1 - 1e-9)))))).alias("score")))
        scores = written(seeds.unionByName(heard).groupBy("instance", "kind").agg(F.max("score").alias("score")), "pii-scores")
        # a score is at least TRUST or there is none: a row is a trusted pattern, or a believed instance
        now = [x for df, c in ((patterns, "confidence"), (scores, "score")) for x in df.agg(F.count("*"), F.coalesce(F.sum(c), F.lit(0.0))).first()]
        if last and now[::2] == last[::2] and abs(now[1] - last[1]) + abs(now[3] - last[3]) <= STILL:
            return patterns, scores
        last = now
    raise RuntimeError(f"scores of patterns and instances still grow after {rounds} rounds")


def find_pii(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS, support: int = SUPPORT,
             trust: float = TRUST) -> DataFrame:
    """One row per input row: row number, ``doc_id``, and ``found``, an array of ``kind, start, end``."""
    rows = identified(docs, doc_id, text, False)
    found = written(_placed(rows), "pii-found")
    edges = written(_edges(found), "pii-edges")
    patterns, scores = bootstrap(edges, rounds, support, trust)
    unseen = edges.filter("seed is null").filter(F.contains("instance", F.lit("@")) | (F.length(_digits(F.col("instance"))) >= 4))
    believed = scores.filter(F.col("score") >= trust)
    added = (unseen.join(patterns, "pattern").join(believed, ["instance", "kind"])
             .select(RID, F.concat(F.lit("ctx_"), "kind").alias("kind"), F.col("from").alias("start"), F.col("to").alias("end")))
    base = found.filter("kind <> 'candidate'").filter(_holds(F.col("kind"), F.col("m"))).select(RID, "kind", "start", "end")
    place = F.array_position(F.array(*map(F.lit, KINDS + ADDED)), F.col("kind"))
    spans = (base.unionByName(added).groupBy(RID)
             .agg(F.array_sort(F.collect_list(F.struct(place.alias("place"), "start", "end", "kind"))).alias("found")))
    none = F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>")
    return (rows.select(RID, "doc_id").join(spans, RID, "left")
            .select(RID, "doc_id", F.coalesce(F.transform("found", lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))), none).alias("found")))


def op2_pii_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all ``documents``."""
    found = find_pii(table(spark, sf_dir, "documents"))
    spans = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    of = lambda kind: F.filter("found", lambda x: x["kind"] == kind)
    base = F.filter("found", lambda x: x["kind"].isin(*KINDS))
    return found.select("doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in KINDS],
                        F.sha2(spans(base), 256).alias("base_sha256"), spans(F.col("found")).alias("spans"))
