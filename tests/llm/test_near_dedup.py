import random
from collections import defaultdict
from functools import partial

import numpy as np

import corpus_pipeline
from signalmesh.llm import near_dedup
from signalmesh.llm.near_dedup import GUARANTEED, HASHES, common_counts, components, drop_near_copies, forest, index_keys, near_groups, op8_minhash_near_dedup
from tests.llm.fixtures import SF2, documents, odd_documents


def shingles(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    """All pairs that share a shingle; union-find over those similar enough."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    where = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            where[x].append(i)
    common = defaultdict(int)
    for at in where.values():
        for a in at:
            for b in at:
                if a < b:
                    common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            parent[find(a)] = find(b)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        ids = [x for x in (least.get(find(i)), doc_id) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return sorted([(d, len(s), least[find(i)], d == least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets))], key=repr)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in documents(spark, SF2).select("doc_id", "text").collect()]
    want = brute(rows)
    assert got(op8_minhash_near_dedup(spark, SF2)) == want
    assert sum(not k for *_, k in want) > 10


def test_odd_rows(spark):
    docs = odd_documents(spark)
    assert got(near_groups(docs)) == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])
    assert near_groups(docs.limit(0)).count() == 0


def test_components_with_one_id_or_none_stay_apart(spark, tmp_path):
    fox, sea, hill = "the quick brown fox jumps over the lazy dog", "a ship sailed out to the open sea at dawn", "we walked up the old hill in the rain"
    rows = [(None, fox), (None, fox), (None, sea), (None, hill), (None, ""), (None, None),  # three components and two without words
            (7, "one text under this id and nothing else at all"), (7, "quite another text that has the same id as well"),
            (9, "pears and plums and figs in a bowl"), (8, "pears and plums and figs in a bowl"), (None, "pears and plums and figs in a bowl")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = [(None, fox), (None, sea), (None, hill), (None, ""), (None, None), rows[6], rows[7], rows[9]]
    by_text = lambda rows: sorted(map(tuple, rows), key=repr)
    assert by_text(drop_near_copies(docs).collect()) == by_text(want)
    assert by_text(corpus_pipeline.near_dedup(spark, docs, "").collect()) == by_text(want)
    assert got(near_groups(docs)) == brute(rows)


def test_chains_and_families_need_several_rounds(spark, tmp_path):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    rows, n = [], 0
    base = [word() for _ in range(120)]
    for _ in range(40):  # a chain: each text is near the one before it
        base = base[6:] + [word() for _ in range(6)]
        rows.append((n := n + 1, " ".join(base)))
    shared = [word() for _ in range(60)]
    for _ in range(40):  # texts that share half of their words: many common keys, no links
        rows.append((n := n + 1, " ".join(shared + [word() for _ in range(40)])))
    rng.shuffle(rows)
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = brute([tuple(r) for r in docs.collect()])
    assert got(near_groups(docs)) == want
    assert drop_near_copies(docs).count() == len({c for _, _, c, _ in want})


def test_family_around_the_limit_in_many_tiles(spark, tmp_path, monkeypatch):
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abcdefghij", k=5))
    base = [word() for _ in range(200)]
    rows = []
    for n in range(150):  # each replaces a few words of one text: similarities on both sides of the limit
        text = list(base)
        for at in rng.sample(range(200), rng.choice([3, 5, 6, 7])):
            text[at] = word()
        rows.append((n, " ".join(text)))
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    want = brute([tuple(r) for r in docs.collect()])
    assert 1 < len({c for _, _, c, _ in want}) < 150
    assert got(near_groups(docs)) == want
    monkeypatch.setattr(near_dedup, "_tiled", partial(near_dedup._tiled, most_rows=20))
    assert got(near_groups(docs)) == want


def test_common_counts_and_forest():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = [np.unique(np.r_[rng.choice(base, rng.integers(1, 280), replace=False), rng.integers(0, 1 << 62, 5).astype(np.uint64)]) for _ in range(60)]
    want = np.array([[len(np.intersect1d(x, y)) for y in sets] for x in sets])
    apart = ~np.eye(len(sets), dtype=bool)
    assert (common_counts(sets)[apart] == want[apart]).all()
    linked = np.zeros((6, 6), bool)
    for x, y in ((0, 3), (3, 5), (0, 5), (1, 2)):
        linked[x, y] = linked[y, x] = True
    assert sorted(map(sorted, forest(linked))) in ([[0, 3], [0, 5], [1, 2]], [[0, 3], [1, 2], [3, 5]])


def test_every_pair_within_the_radius_shares_a_key():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 1 << 16, (300, HASHES)).astype("<u2")
    b = a.copy()
    for row in b:
        at = rng.choice(HASHES, GUARANTEED, replace=False)
        row[at] ^= 1
    assert (index_keys(a) == index_keys(b)).any(axis=1).all()


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1100)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    least = defaultdict(lambda: 1 << 60)
    for x in parent:
        least[find(x)] = min(least[find(x)], x)
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert {(r.node, r.component) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == {(x, least[find(x)]) for x in linked}
