import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest

from signalmesh.llm.collocations import ORACLE_SQL, collocations, equal_partitions, op13_collocations
from tests.llm.fixtures import SF2, documents, odd_documents

COLUMNS = "lang", "rank", "phrase", "a", "l", "r", "n", "score"


def brute(rows, least=10, share=50, top=2000):
    f, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lowered = "".join(c.lower() if c.isascii() else c for c in text or "")
        for piece in re.split("[.,;:!?\n-\r]", lowered):
            words = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(words)
            f.update((lang, tuple(words[i: i + k])) for k in (1, 2, 3) for i in range(len(words) - k + 1))
    out = []
    frequent = {key: a for key, a in f.items() if len(key[1]) > 1 and a >= least}
    for (lang, p), a in frequent.items():
        if any(g == lang and len(q) == 3 and len(p) == 2 and p in (q[:2], q[1:]) and 100 * b >= share * a for (g, q), b in frequent.items()):
            continue
        scores = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
        score, k = min(scores)
        out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], score))
    ranked = []
    for lang in {r[0] for r in out}:
        best = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i, *r[1:]) for i, r in enumerate(best, 1)]
    return sorted(ranked)


def got(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()))


@pytest.mark.parametrize("few", [1, 4, 24])
def test_equal_partitions_are_prefix_counts(few):
    rng = np.random.default_rng(few)
    for n, v in ((1, 2), (50, 3), (3000, 6), (3000, 400)):
        words = [rng.integers(1, v, n), rng.integers(0, v, n), rng.integers(0, v, n)]
        words[2][words[1] == 0] = 0
        weight = rng.integers(1, 4, n)
        want = Counter()
        for i in range(n):
            for k in range(3):
                if words[k][i]:
                    want[tuple(int(w[i]) for w in words[: k + 1])] += int(weight[i])
        want = {p: c for p, c in want.items() if len(p) < 3 or c >= 5}
        have = [(tuple(int(w[p]) for w in words[: k + 1]), int(c)) for k, at, weights in equal_partitions(words, weight, 5, few)
                for p, c in zip(at, weights)]
        assert len(have) == len(want) and dict(have) == want


def test_query_equals_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF2}/documents.parquet'")
    want = sorted(con.sql(f"SELECT {', '.join(COLUMNS)} FROM ({ORACLE_SQL})").fetchall())
    assert got(op13_collocations(spark, SF2)) == want and len(want) > 200


def test_small_stretches_and_tasks_change_nothing(spark):
    rows = [tuple(r) for r in documents(spark).select("text", "lang").collect()]
    want = brute(rows)
    assert got(collocations(documents(spark), stretch=500, task_bytes=3000)) == want and want
    assert got(collocations(documents(spark), top=7, least=4)) == brute(rows, least=4, top=7)


def test_ties_hot_pairs_and_pieces(spark):
    rng = random.Random(1)
    rows = [("Of the " + rng.choice("abcdefghijklmnop") + str(i % 40), "en") for i in range(2000)]
    rows += [("x y z" if i % 2 else "X\tY  z", None) for i in range(20)] + [("x y. z; x\x0by z", "und")] * 12
    rows += [(" ".join(["go"] * 50), "de"), ("é É é É " * 10, "de"), ("  a b " * 12, "de")]
    df = spark.createDataFrame([(*r, 1, "n") for r in rows], "text string, lang string, n int, phrase string").repartition(7)
    assert got(collocations(df, stretch=300, task_bytes=2000)) == brute(rows)


def test_the_filter_misses_no_pair(spark, monkeypatch):
    from signalmesh.llm import collocations as c

    rows = [("en", f"w{i % 70}", f"v{i // 70}") for i in range(3000)]
    f = c.pair_filter(spark.createDataFrame(rows, "lang string, w1 string, w2 string").repartition(3))
    hashes = lambda rows: c.pair_hash(*[np.array([c._hash(x) for x in col], np.uint64) for col in zip(*rows)])
    assert f.holds(hashes(rows)).all()
    assert f.holds(hashes([("en", f"w{i % 70}", f"x{i // 70}") for i in range(3000)])).mean() < 0.05
    # a filter far too small lets pairs pass, and the result is the same
    monkeypatch.setattr(c, "MOST_BITS", 64)
    rows = [tuple(r) for r in documents(spark).select("text", "lang").collect()]
    assert got(collocations(documents(spark))) == brute(rows)


def test_products_beyond_64_bits(spark):
    from signalmesh.llm.collocations import _floor_score
    from pyspark.sql import functions as F

    a, left, right = 9_000_000_000_000_001, 9_000_000_000_000_003, 9_000_000_000_000_007
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long").select(_floor_score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert df.first()[0] == 1_000_000 * a * a // (left * right)


def test_odd_rows(spark):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("text", "lang").collect()]
    assert got(collocations(docs, least=2)) == brute(rows, least=2)
    assert collocations(docs.limit(0)).count() == 0


def test_a_very_long_text(spark):
    rows = [("tick tock " * 400_000, "en"), ("w" * 3_000_000, "en")]
    assert got(collocations(spark.createDataFrame(rows, "text string, lang string"))) == brute(rows)
