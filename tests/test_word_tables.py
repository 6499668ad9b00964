"""Words and pairs by tables equal a search of every keyword in every text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from signalmesh.operators import word_tables as wt


def found(texts, keywords, whole_only):
    t = wt.tables(pa.table([pa.array(c, k) for c, k in zip(zip(*keywords), (pa.int32(), pa.string(), pa.string()))] if keywords else
                           [pa.array([], k) for k in (pa.int32(), pa.string(), pa.string())], ["theme", "first", "last"]))
    data = [x.encode() for x in texts]
    text, theme = wt.hits(t, wt._bytes(pa.py_buffer(b"".join(data))), np.cumsum([0, *map(len, data)]), np.array(whole_only, bool))
    themes = t.themes.to_pylist()
    out = [(int(i), themes[j]) for i, j in zip(text, theme)]
    assert len(out) == len(set(out))
    return set(out)


def searched(texts, keywords, whole_only):
    words = [set(re.findall("[A-Za-z0-9_]+", t)) for t in texts]
    return {(i, theme) for i, t in enumerate(texts) for theme, first, last in keywords
            if (first in words[i] if last is None else not whole_only[i] and f"{first} {last}" in t)}


@pytest.mark.parametrize("weak", [None, lambda h: h * np.uint64(0), lambda h: h >> np.uint64(61) << np.uint64(61)])
def test_random_texts_whatever_the_hash(monkeypatch, weak):
    if weak:
        hashed = wt.hashed
        monkeypatch.setattr(wt, "hashed", lambda *a: weak(hashed(*a)))
        monkeypatch.setattr(wt, "AT_ONCE", 3)
    n = 0
    for seed in range(150):
        rng = random.Random(seed)
        pool = ["".join(rng.choice("aab1_") for _ in range(rng.choice([1, 2, 3, 8, 9, 16, 17]))) for _ in range(12)]
        texts = ["".join(rng.choice([*pool, " ", " ", "  ", ".", "é", "\n", "b"]) for _ in range(rng.randrange(25))) for _ in range(rng.randrange(30))]
        themes = [None, *range(rng.choice([1, 3, 64, 65, 200]))]
        keywords = [*{(rng.choice(themes), rng.choice(pool), rng.choice([None, rng.choice(pool)])) for _ in range(rng.randrange(60))}]
        whole_only = [rng.random() < 0.1 for _ in texts]
        want = searched(texts, keywords, whole_only)
        assert found(texts, keywords, whole_only) == want
        n += len(want)
    assert n > 1000


def test_a_pair_is_the_end_and_the_beginning_of_longer_words():
    keywords = [(0, "time", "slot"), (1, "overtime", "slots"), (2, "slots", None), (None, "e", "s"), (3, "time", "slotsx")]
    assert found(["overtime slots", "time  slot", "time", " slot", "time\nslot", "xtime slot."], keywords, [False] * 6) == {(0, 0), (0, 1), (0, 2), (0, None), (5, 0), (5, None)}
    assert found(["overtime slots", ""], keywords, [True, False]) == {(0, 2)}


def test_a_very_long_word_and_one_longer_than_any_keyword():
    long = "x" * 300_000
    assert found([long, f"{long}y z", f"a{long} zz"], [(0, long, None), (1, long, "z"), (2, "y", "z")], [False] * 3) == {(0, 0), (1, 2), (2, 1)}
