"""J1 for large catalogues: keywords as an inverted index instead of predicates.

A catalogue edited by people compiles into predicates (``themes.py``).  One of
tens of thousands of keywords does not: the plan would grow with it and every text would be
tested for every keyword.  Here the catalogue is a table that texts meet, so that the plan
is the same for any catalogue.

A word is a run of ``[A-Za-z0-9_]``.  Keywords that are one word (``whole``) or two with
a space between (``pair``) are most of a large catalogue: they are told by
:mod:`~signalmesh.operators.word_tables`, which are sent to where texts are read.  A table holds
``TABLE`` index rows (some 30 bytes each), and texts are read and cut once for each table.

The others are met by an equi-join; each hangs on one of its parts, its anchor:

* a keyword without a space matches between word boundaries, so each of its words
  is a whole word of the text (``exact``);
* a keyword with a space is a plain substring.  Where two of its words are parted by
  one space, the text has that joint too: it hangs on the space and at most
  ``AROUND`` letters on either side (``joint``), the longest it has.  Without a joint its
  inner words are whole words of the text, but the first may be the end (``tail``) and the
  last the beginning (``head``) of a longer one;
* a keyword without any word hangs on its first character (``sign``).

Exact anchors are preferred, then long ones, which are rare.  A text so offers
its distinct words, their heads and tails of the lengths that anchors have, the
signs, and its pairs of words with one space between.  What the join leaves is confirmed
on the texts of its rows.

A text offers many times its own size and common keywords hit nearly every text, so
neither is shuffled: the index of these keywords is dealt into slices of at most about ``SLICE``, each
of which is broadcast and met where the texts are read.  One table or slice is in memory at a
time, whatever the catalogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from signalmesh.functions.pii import WORD
from signalmesh.functions.text import B_LEFT, B_RIGHT
from signalmesh.operators import word_tables
from signalmesh.session import materialize, ship

EXACT, HEAD, TAIL, SIGN, JOINT = "=<>?|"
WORDS = f"[{WORD}]+"
#: Two words and the space between, from every word of a text.
PAIRS = rf"(?<![{WORD}])(?=([{WORD}]+ [{WORD}]+))"
#: Letters of a joint on either side; index rows of a slice and of a table, about.
AROUND, SLICE, TABLE = 4, 1_000_000, 3_000_000
# Characters with a meaning in a pattern.
META = r"([.*+?^${}()|\[\]\\\-/])"


def _words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORDS), 0)


def _pairs(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit(PAIRS), 1))


def _joint(pair: Column, before: Column, after: Column) -> Column:
    """The space of ``pair`` with ``before`` and ``after`` letters around it."""
    return F.concat(F.lit(JOINT), F.substring(pair, F.instr(pair, " ") - before, before + 1 + after))


def keyword_index(keywords: DataFrame, theme: str = "theme_idx", keyword: str = "keyword") -> DataFrame:
    """``theme, keyword, anchor, whole, pair``: one row per theme and distinct lower-cased keyword; empty ones match nothing.

    An anchor is its kind's mark and a string, so that both are one join key.
    ``whole``: the keyword is one word; ``pair``: two words and the space between.
    """
    k = (keywords.select(F.col(theme).alias("theme"), F.lower(F.col(keyword)).alias("keyword")).distinct()
         .filter(F.coalesce(F.length("keyword"), F.lit(0)) > 0).withColumn("words", _words(F.col("keyword"))))
    phrase = F.contains("keyword", F.lit(" "))
    opens = F.regexp_like("keyword", F.lit(f"^[{WORD}]"))
    closes = F.regexp_like("keyword", F.lit(f"[{WORD}]$"))
    last = F.size("words") - 1

    def anchor(word: Column, i: Column) -> Column:
        kind = F.when(phrase & opens & (i == 0), TAIL).when(phrase & closes & (i == last), HEAD).otherwise(EXACT)
        return F.struct((kind == EXACT).alias("first"), F.length(word).alias("length"), F.concat(kind, word).alias("anchor"))

    def joint(pair: Column) -> Column:
        at = F.instr(pair, " ")
        at = _joint(pair, F.least(at - 1, F.lit(AROUND)), F.least(F.length(pair) - at, F.lit(AROUND)))
        return F.struct(F.lit(True).alias("first"), F.length(at).alias("length"), at.alias("anchor"))

    best = F.coalesce(F.array_max(F.transform(_pairs(F.col("keyword")), joint)), F.array_max(F.transform("words", anchor)))
    k = k.withColumn("a", F.coalesce(best, F.struct(F.lit(False).alias("first"), F.lit(1).alias("length"),
                                                    F.concat(F.lit(SIGN), F.substring("keyword", 1, 1)).alias("anchor"))))
    return k.select("theme", "keyword", F.col("a.anchor").alias("anchor"), (F.col("a.anchor") == F.concat(F.lit(EXACT), "keyword")).alias("whole"),
                    F.regexp_like("keyword", F.lit(f"^[{WORD}]+ [{WORD}]+$")).alias("pair"))


def _lengths(index: DataFrame) -> dict[str, list]:
    """The lengths that heads, tails and signs have, no more than the longest anchor's letters, and those of joints before and after the space."""
    anchor = F.substring_index("anchor", " ", 1)
    rows = index.select(F.left("anchor", F.lit(1)).alias("kind"), (F.length(anchor) - 1).alias("n"),
                        (F.length("anchor") - F.length(anchor) - 1).alias("after")).distinct().collect()
    return {kind: sorted({r.n for r in rows if r.kind == kind}) for kind in (HEAD, TAIL, SIGN)} | {
        JOINT: sorted((r.n, r.after) for r in rows if r.kind == JOINT)}


def offered(text: Column, lengths: dict[str, list]) -> Column:
    """What a text offers to anchors, each once (strings, which Spark tells apart by hashing); pairs whole, as :func:`with_anchors` cuts them."""
    offer = lambda kind, c: F.concat(F.lit(kind), c)
    words = F.array_distinct(_words(text))
    parts = [F.transform(words, lambda w: offer(EXACT, w))]

    def cuts(kind: str, cut) -> Column:
        sizes = F.array(*map(F.lit, lengths[kind]))
        return F.array_distinct(F.flatten(F.transform(words, lambda w: F.transform(
            F.filter(sizes, lambda n: n <= F.length(w)), lambda n: offer(kind, cut(w, n))))))

    if lengths[HEAD]:
        parts.append(cuts(HEAD, lambda w, n: F.substring(w, F.lit(1), n)))
    if lengths[TAIL]:
        parts.append(cuts(TAIL, lambda w, n: F.right(w, n)))
    if lengths[SIGN]:
        signs = F.array_distinct(F.regexp_extract_all(text, F.lit(f"[^{WORD}]"), 0))
        parts.append(F.transform(signs, lambda s: offer(SIGN, s)))
    if lengths[JOINT]:
        parts.append(F.transform(_pairs(text), lambda p: offer(JOINT, p)))
    return F.concat(*parts)


def with_anchors(tokens: DataFrame, lengths: dict[str, list]) -> DataFrame:
    """The anchors that an offered ``token`` meets: itself, or a pair's joints of the lengths that anchors have."""
    token, at = F.col("token"), F.instr("token", " ")
    pair = F.startswith(token, F.lit(JOINT))
    joints = [F.when(~pair, token).when((at - 2 >= i) & (F.length(token) - at >= j), _joint(token, F.lit(i), F.lit(j))) for i, j in lengths[JOINT]]
    if len(joints) < 2:
        return tokens.withColumn("anchor", joints[0] if joints else token)
    return tokens.withColumn("anchor", F.explode(F.when(pair, F.array(*joints)).otherwise(F.array(token))))


def confirmed(text: Column, keyword: Column) -> Column:
    """X8 for a keyword in a column: a phrase as a substring, another between word boundaries."""
    pattern = F.concat(F.lit(B_LEFT), F.regexp_replace(keyword, META, r"\\$1"), F.lit(B_RIGHT))
    return F.when(F.contains(keyword, F.lit(" ")), F.contains(text, keyword)).otherwise(F.regexp_like(text, pattern))


def _hits(tokens: DataFrame, index: DataFrame, key: list[str]) -> DataFrame:
    """Distinct ``key..., theme, keyword`` whose anchor a text offers, still to be confirmed."""
    # a keyword's themes (no more than there are, a null one among them) ride on one row
    at = (index.groupBy("anchor", "keyword")
          .agg(F.transform(F.collect_list(F.struct("theme")), lambda x: x["theme"]).alias("themes")))
    known = F.lit(True)
    for c in key:  # confirming joins by key, which a null one never meets
        known = known & F.col(c).isNotNull()
    met = tokens.join(F.broadcast(at), "anchor").filter(known)
    return met.select(*key, F.explode("themes").alias("theme"), "keyword").distinct()


def _slices(index: DataFrame, n: int) -> list[DataFrame]:
    """The index dealt by keyword, so that a common anchor is dealt too."""
    of = F.pmod(F.xxhash64("keyword"), F.lit(n))
    return [index.filter(of == i) for i in range(n)] if n > 1 else [index]


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _in_tables(rows: DataFrame, index: DataFrame, key: list[str], text: str, n: int) -> DataFrame:
    """``key..., theme`` of the keywords that are a word or a pair, by ``n`` tables; a theme may come more than once."""
    spark = rows.sparkSession
    ship(spark)
    known = F.lit(True)
    for c in key:
        known = known & F.col(c).isNotNull()
    given = rows.select(*key, F.coalesce(F.col(text), F.lit("")).alias("__text"), (~known).alias("__whole_only"))
    result = StructType([*given.select(*key).schema.fields, StructField("__themes", ArrayType(index.schema["theme"].dataType))])

    def met(part: DataFrame):
        words = part.select("theme", F.substring_index("keyword", " ", 1).alias("first"), F.when(F.col("pair"), F.substring_index("keyword", " ", -1)).alias("last"))
        held = spark.sparkContext.broadcast(word_tables.tables(words.toArrow()))
        return held, given.mapInArrow(lambda b: word_tables.matched(b, held.value), result).select(*key, F.explode("__themes").alias("theme"))

    if n == 1:
        return met(index)[1]
    parts = []
    for part in _slices(index, n):  # each written before the next is sent out
        held, found = met(part)
        parts.append(materialize(found, "keyword-hits"))
        held.destroy()
    return _all(parts)


def match_by_index(rows: DataFrame, index: DataFrame, key: list[str], text: str = "text", slice_size: int | None = None) -> DataFrame:
    """Distinct ``key..., theme`` of the rows whose lower-case ``text`` hits a keyword of the theme.

    ``key`` tells rows apart (rows that share one count as one row with all
    their hits).  Null texts match nothing.  ``slice_size``: index rows of a table or slice, about.
    """
    told = F.col("whole") | F.col("pair")
    size = index.agg(F.count_if(told).alias("told"), F.count_if(~told).alias("open")).first()
    hits = []
    if size.told or not size.open:
        hits.append(_in_tables(rows, index.filter(told), key, text, -(-size.told // (slice_size or TABLE)) or 1))
    if size.open:
        index = index.filter(~told)
        lengths = _lengths(index)
        tokens = with_anchors(rows.select(*key, F.explode(offered(F.coalesce(F.col(text), F.lit("")), lengths)).alias("token")), lengths)
        # texts are joined to candidates afterwards, so that no word carries its text; each slice is written before the next is broadcast
        maybe = _all([materialize(_hits(tokens, part, key), "keyword-hits") for part in _slices(index, -(-size.open // (slice_size or SLICE)))])
        hits.append(maybe.join(rows.select(*key, F.col(text).alias("__text")), key).filter(confirmed(F.col("__text"), F.col("keyword"))).select(*key, "theme"))
    return _all(hits).distinct()
