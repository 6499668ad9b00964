import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
from tokenizers import Tokenizer

from signalmesh.llm.token_align import SEPARATORS, ByteTokens, PieceTokens, Sides, align, align_tokenizers, op11_token_align, runs
from tests.llm.fixtures import ODD_TEXTS, SF, documents, odd_documents

STRANGE = ["▁", "a▁b", "<0x41>", "<s> </s> <unk>", "<|endoftext|> x", "日本語 のテキスト", "　 wide", "a" * 3000, " " * 1500, "x " * 300,
           "1 234,5", "it's we'll 'S", "ǅ ɐ Ω λ", " private", "tail ", "  two  gaps  ", "\r\n\r\n", "\x7f\x01"]

NAMES = np.array([[f"{k}{after}" for k in range(99)] for after in SEPARATORS], object)


@pytest.fixture(scope="module")
def vocabularies():
    return ByteTokens(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken")), PieceTokens(P.path("piece_bpe_32k.model"))


def brute(rows):
    """All pairs of tokens of a text compared; counts over all texts."""
    slow = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    slow.encode_special_tokens = True
    vocab = {i: t for t, i in slow.get_vocab().items()}
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in kept)}
    pieces = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))

    def b_bytes(i):
        p = pieces.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace("▁", " ").encode()

    def ranges(parts):
        at, out = 0, []
        for p in parts:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    counts, held = Counter(), []
    for doc_id, text in rows:
        a = slow.encode(" " + text, add_special_tokens=False).ids if text else []
        b = pieces.encode(text) if text else []
        pa, pb = [bytes(letter[c] for c in vocab[i]) for i in a], [b_bytes(i) for i in b]
        if not text or b"".join(pa) != b" " + text.encode() or b"".join(pb) != b" " + text.encode():
            held.append((doc_id, [], [], [], ""))
            continue
        ra, rb = ranges(pa), ranges(pb)
        links = [(x, y) for x, (s, e) in enumerate(ra) for y, (t, f) in enumerate(rb) if s < f and t < e]
        shared = sorted({e for _, e in ra} & {e for _, e in rb})
        groups, start = [], 0
        for end in shared:
            groups.append((",".join(str(i) for i, (s, e) in zip(a, ra) if start <= s < end),
                           ",".join(str(i) for i, (s, e) in zip(b, rb) if start <= s < end)))
            start = end
        counts.update((a[x], b[y]) for x, y in links)
        held.append((doc_id, a, b, [(a[x], b[y]) for x, y in links], ";".join("|".join(g) for g in groups)))
    top = Counter()
    for (_, y), n in counts.items():
        top[y] = max(top[y], n)
    return sorted([(d, len(a), len(b), said.count(";") + 1 if said else 0, len(links), sum(counts[p] == top[p[1]] for p in links),
                    sum(counts[p] for p in links), hashlib.sha256(said.encode()).hexdigest() if said else "") for d, a, b, links, said in held], key=repr)


def got(df):
    return sorted(map(tuple, df.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=repr)


def test_runs_cover_both_sides_and_stop_at_shared_ends():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(1, 60)
        a = sorted({*rng.sample(range(1, n + 1), rng.randrange(n)), n})
        b = sorted({*rng.sample(range(1, n + 1), rng.randrange(n)), n}) if rng.random() < 0.7 else list(a)
        i = j = 0
        ends = []
        for i0, i1, j0, j1 in runs(np.array(a), np.array(b)):
            assert (i0, j0) == (i, j)
            if i1 < 0:
                i1 = -i1
                assert i1 - i0 == j1 - j0 > 0 and a[i0:i1] == b[j0:j1]
                ends += a[i0:i1]
            else:
                assert a[i1 - 1] == b[j1 - 1] and (i1 - i0, j1 - j0) != (1, 1) and not set(a[i0:i1 - 1]) & set(b[j0:j1 - 1])
                ends.append(a[i1 - 1])
            i, j = i1, j1
        assert (i, j) == (len(a), len(b)) and ends == sorted(set(a) & set(b))
        spans = [list(zip([0, *e], e)) for e in (a, b)]
        links = [(x, y) for x, (s, e) in enumerate(spans[0]) for y, (t, f) in enumerate(spans[1]) if s < f and t < e]
        at = [np.arange(len(e)) for e in (a, b)]
        n, link_a, link_b, _ = align(*at, np.array(a), np.array(b), NAMES)
        assert sorted(zip(link_a.tolist(), link_b.tolist())) == links and n == len(ends)


def test_links_of_an_irregular_group():
    n, a, b, said = align(np.array([1, 2, 3]), np.array([7, 8]), np.array([2, 5, 6]), np.array([4, 6]), NAMES)
    assert (n, a.tolist(), b.tolist(), said) == (1, [1, 2, 2, 3], [7, 7, 8, 8], "1,2,3|7,8")
    assert align(np.array([1, 2]), np.array([7, 8]), np.array([1, 2]), np.array([1, 2]), NAMES)[3] == "1|7;2|8"


def test_parts_and_both_readers_give_the_whole_text_s_ids(vocabularies, spark):
    rng = random.Random(2)
    texts = ODD_TEXTS + STRANGE + [r.text for r in documents(spark).limit(60).collect()]
    texts += ["".join(rng.choice(" \t\n\xa0éß.,'0aZ\x85\x1c^") for _ in range(200)) for _ in range(50)]
    whole, cut = Sides(*vocabularies), Sides(*vocabularies, part=40)
    for text in texts:
        a, b, a_ends, b_ends = whole.tokens(text)
        if len(a):
            assert a.tolist() == vocabularies[0].slow.encode(" " + text, add_special_tokens=False).ids and b.tolist() == vocabularies[1].model.encode(text)
            assert a_ends[-1] == b_ends[-1] == len(text.encode()) + 1
        assert [list(x) for x in cut.tokens(text)] == [list(a), list(b), list(a_ends), list(b_ends)]


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in documents(spark).select("doc_id", "text").collect()]
    small = [(d, t) for d, t in rows if len(t) < 3000]
    df = spark.createDataFrame(small, "doc_id long, text string").repartition(5)
    assert got(align_tokenizers(df)[0]) == brute(small)
    whole = op11_token_align(spark, SF)
    assert whole.count() == len(rows) and whole.filter("n_links <> n_a + n_b - n_groups").count() == 0


def test_odd_rows_and_pair_counts(spark):
    docs = odd_documents(spark)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()] + [(1000 + i, t) for i, t in enumerate(STRANGE)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, pair string, n int")
    out, pairs = align_tokenizers(df)
    want = brute(rows)
    assert got(out) == want
    assert pairs.agg({"n": "sum"}).first()[0] == sum(r[4] for r in want)
    assert align_tokenizers(docs.limit(0))[0].count() == 0


def test_a_very_long_text(spark):
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "gamma,", "délta", "x1"]) for _ in range(300_000)) + "q" * 20_000
    row = align_tokenizers(spark.createDataFrame([(1, text), (2, "alpha beta")], "doc_id long, text string"))[0].filter("doc_id = 1").first()
    assert row.n_links == row.n_a + row.n_b - row.n_groups and row.n_groups > 300_000
