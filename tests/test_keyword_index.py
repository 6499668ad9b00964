"""J1 by keyword index equals the predicates, for any catalogue."""

import random

import pytest
from pyspark.sql import functions as F

from feeds import feeds, post, ticket
from signalmesh.config import DEFAULT_THEMES, themes_frame
from signalmesh.functions import text as tx
from signalmesh.operators import keyword_index as ki
from signalmesh.operators import normalize as nz
from signalmesh.operators import themes as th
from signalmesh.params import Params
from signalmesh.plans.analysis import analyze
from signalmesh.session import materialize

SF = "/root/testdata/sf0.001"
STRANGE = ("api", "make.com", "opt-in", "c++", ".net", "double opt", "time slot", " lead", "trail ", "a b c", "++", "→", "e-mail us", "API", "é t", "x_1",
           "500 error", "(beta)", "$5", "no\\w", "foo  bar", "- -", "_")
TEXTS = ["the api broke", "rapid", "éapi works", "api-key", "make.com rocks", "makexcom", "xmake.com", "make.comx", "double option", "redouble opt",
         "double  opt", "time slots", "overtime slot", "c++ and .net", "dotnet .networks", "a b c", "xa b cy", "++", "1 → 2", "e-mail used", "(beta) $5",
         "no\\w now", "foo  bar", "- - -", "a_b _ c", "", " lead", "trail ", "mislead trailx", "é t", "x_1 x_12", "500 errors", "1500 error", "opt-in.", None]


def by_predicate(spark, rows, keywords):
    """Every keyword tested on every text."""
    df = spark.createDataFrame(rows, "id long, text string")
    hits = F.array(*[F.when(tx.keyword_match(F.coalesce("text", F.lit("")), [k]), F.lit(t)) for t, k in keywords])
    return {(r.id, t) for r in df.select("id", hits.alias("h")).collect() for t in r.h if t is not None}


def by_index(spark, rows, keywords):
    index = ki.keyword_index(spark.createDataFrame(keywords, "theme_idx int, keyword string"))
    got = ki.match_by_index(spark.createDataFrame(rows, "id long, text string"), index, ["id"]).collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


def test_strange_keywords_and_texts(spark):
    rows = list(enumerate(t if t is None else t.lower() for t in TEXTS))
    keywords = list(enumerate(STRANGE))
    got = by_index(spark, rows, keywords)
    assert got == by_predicate(spark, rows, keywords) and len(got) > 30
    assert by_index(spark, rows, [(0, "")]) == set() and by_index(spark, rows, []) == set()


@pytest.mark.parametrize("seed", [1, 2])
def test_random_keywords(spark, seed):
    rng = random.Random(seed)
    piece = lambda n: "".join(rng.choice("aab_1 -.") for _ in range(n))
    rows = [(i, piece(rng.randrange(40))) for i in range(150)]
    keywords = [(i, k) for i, k in enumerate({piece(rng.randrange(1, 6)) for _ in range(60)})]
    assert by_index(spark, rows, keywords) == by_predicate(spark, rows, keywords)


def test_default_catalogue_tags_the_same_signals(spark):
    words = [k for t in DEFAULT_THEMES.themes for k in t.keywords]
    rng = random.Random(3)
    tickets = [ticket(i, f"{rng.choice(words)} {rng.choice(['x', 's', ''])}", f"{rng.choice(words)}y, {rng.choice(words).upper()}.") for i in range(120)]
    f = feeds(spark, [*tickets, tickets[0], ticket(0, "another of one id")], [post(i, rng.choice(words)) for i in range(20)])
    signals = analyze(f, DEFAULT_THEMES, Params()).signals.drop("theme_idxs")
    want = th.tag_signals(signals, DEFAULT_THEMES)
    got = th.tag_signals_by_index(signals, themes_frame(spark, DEFAULT_THEMES))
    rows = lambda df: sorted((r.id, str(r.ord), r.title, r.body, list(r.theme_idxs)) for r in df.collect())
    assert rows(got) == rows(want) and got.columns == want.columns


def test_fifty_thousand_keywords_have_the_same_plan(spark, capsys):
    docs = nz.with_text(analyze(feeds(spark, [ticket(1, "word77 and word5 word6", "word49999")], []), DEFAULT_THEMES, Params()).signals)

    def plan(n):
        words = spark.range(n).select((F.col("id") % 9).cast("int").alias("theme_idx"), F.concat(F.lit("word"), "id").alias("keyword"))
        pairs = spark.range(n).select(F.lit(9).alias("theme_idx"), F.concat(F.lit("word"), "id", F.lit(" word"), F.col("id") + 1).alias("keyword"))
        index = ki.keyword_index(words.unionByName(pairs)).cache()
        hits = ki.match_by_index(docs, index, ["id"])
        found = sorted(r.theme for r in hits.collect())
        hits.explain("simple")
        index.unpersist()
        return found, capsys.readouterr().out

    (few, small), (many, large) = plan(100), plan(50_000)
    assert few == sorted({77 % 9, 5 % 9, 6 % 9, 9})
    assert many == sorted({77 % 9, 5 % 9, 6 % 9, 49999 % 9, 9})
    assert abs(len(small) - len(large)) < 0.2 * len(small)


def test_pairs_hang_on_the_space_between_their_words(spark):
    index = ki.keyword_index(spark.createDataFrame([(0, "double opt"), (1, "a b c"), (2, "foo  bar"), (3, "api")], "theme_idx int, keyword string"))
    got = {r.keyword: (r.anchor, r.whole, r.pair) for r in index.collect()}
    assert got["double opt"] == ("|uble opt", False, True) and got["api"] == ("=api", True, False)
    assert got["a b c"][0] in ("|a b", "|b c") and not got["a b c"][2] and got["foo  bar"][0][0] in "<>"


@pytest.mark.parametrize("size", [1, 7])
def test_slices_of_the_index_are_met_in_place(spark, size):
    rows = list(enumerate(t if t is None else t.lower() for t in TEXTS))
    keywords = [(t % 5, k) for t, k in enumerate(STRANGE)] + [(9, "double opt"), (9, "slots")]
    index = ki.keyword_index(spark.createDataFrame(keywords, "theme_idx int, keyword string"))
    df = spark.createDataFrame(rows, "id long, text string")
    got = [tuple(r) for r in ki.match_by_index(df, index, ["id"], slice_size=size).collect()]
    assert len(got) == len(set(got)) and set(got) == by_predicate(spark, rows, keywords)


def test_offered_words_are_not_shuffled(spark, capsys):
    index = ki.keyword_index(spark.createDataFrame([(0, "api"), (1, "double opt")], "theme_idx int, keyword string"))
    df = spark.createDataFrame([(1, "the api, redouble option")], "id long, text string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        hits = ki.match_by_index(df, index, ["id"])
        hits.explain("simple")
        assert "SortMergeJoin" not in capsys.readouterr().out
        assert {tuple(r) for r in hits.collect()} == {(1, 0), (1, 1)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_a_text_is_read_once_for_more_than_a_million_keywords(spark):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    n = 700_000
    words = spark.range(n).select((F.col("id") % 9).cast("int").alias("theme_idx"), F.concat(F.lit("word"), "id").alias("keyword"))
    pairs = spark.range(n).select(F.lit(9).alias("theme_idx"), F.concat(F.lit("word"), "id", F.lit(" word"), F.col("id") + 1).alias("keyword"))
    index = materialize(ki.keyword_index(words.unionByName(pairs)), "keyword-index")
    df = spark.createDataFrame([(1, "word77, aword5 word66"), (2, "word699999"), (3, "a word"), (4, None)], "id long, text string")
    hits = ki.match_by_index(df.mapInArrow(counted, df.schema), index, ["id"])
    assert {tuple(r) for r in hits.collect()} == {(1, 77 % 9), (1, 66 % 9), (1, 9), (2, 699999 % 9)}
    assert reads.value == 4
