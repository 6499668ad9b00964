import hashlib
import random
import time
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

from signalmesh.llm.suffix_dedup import drop_repeated, op6_suffix_dedup, regions, sort_shard
from signalmesh.session import tables_folder
from tests.llm.fixtures import SF, documents, odd_documents


def brute(texts, length):
    """Count every window; remove the bytes of those seen twice."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i: i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, np.int8)
        for i in range(len(d) - length + 1):
            if seen[d[i: i + length]] > 1:
                gone[i: i + length] = 1
        kept = bytes(b for b, g in zip(d, gone) if not g)
        out.append((len(d), int(gone.sum()), int((np.diff(gone, prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def got(lose, keep):
    out = [(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in lose.collect()]
    return sorted(out + [(r.doc_id, r.n_bytes, 0, 0, r.sha.hex()) for r in keep.collect()], key=repr)


def test_query(spark):
    rows = documents(spark, SF).select("doc_id", "text").collect()
    want = sorted((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 400)))
    assert sorted(tuple(r) for r in op6_suffix_dedup(spark, SF).collect()) == want
    assert sum(w[2] > 0 for w in want) > 5


def hard_texts(seed):
    rng = random.Random(seed)
    word = lambda n: "".join(rng.choices("abé \n", k=n))
    shared = [word(rng.randrange(20, 90)) for _ in range(6)]
    out = ["".join(rng.choice([word(rng.randrange(1, 60)), rng.choice(shared)]) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    return out + ["a" * 200, "ab" * 90, "a" * 37, "", None, shared[0], shared[0], shared[1] * 3]


@pytest.mark.parametrize("memory,block", [(96 << 20, 1 << 18), (1000, 7)])
def test_hard_texts_in_memory_and_on_disk(spark, tmp_path, memory, block):
    texts = hard_texts(block)
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = docs.collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 40))), key=repr)
    assert got(*drop_repeated(docs, length=40, k=8, memory=memory, block=block)) == want


def test_blocks_do_not_change_a_shard():
    rng = random.Random(3)
    text = "".join(rng.choices("ab", k=3000)).encode()
    rows = sorted((h, bytes([i % 256, i // 256]), a - lo, hi - lo, text[lo: hi + 15]) for i, (h, a, lo, hi) in enumerate(regions(text, 16, 8)))
    assert list(sort_shard(iter(rows), 16, 8)) == list(sort_shard(iter(rows), 16, 8, 100, 5))


def test_odd_rows(spark, tmp_path):
    odd_documents(spark).write.parquet(str(tmp_path / "d"))
    docs = spark.read.parquet(str(tmp_path / "d"))
    rows = docs.collect()
    want = sorted(((r.doc_id, *b) for r, b in zip(rows, brute([r.text for r in rows], 40))), key=repr)
    assert got(*drop_repeated(docs, length=40, k=8)) == want
    assert got(*drop_repeated(docs.limit(0))) == []


def on_disk(spark):
    """Tables written by name, and shuffle files."""
    tables = Path(tables_folder(spark).removeprefix("file:"))
    local = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().localDirsString()
    return set(tables.glob("*")), {f for d in local for f in Path(d).rglob("shuffle_*")}


def test_steps_leave_only_what_is_read_later(spark, tmp_path):
    spark.createDataFrame(list(enumerate(hard_texts(7))), "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "d"))
    tables, shuffles = on_disk(spark)
    keys = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.parquet.compression.codec"]
    before = [spark.conf.get(key) for key in keys]
    drop_repeated(spark.read.parquet(str(tmp_path / "d")), length=40, k=8)
    assert [spark.conf.get(key) for key in keys] == before
    until = time.time() + 5  # executors delete shuffles without being waited for
    while on_disk(spark)[1] - shuffles and time.time() < until:
        time.sleep(0.1)
    made = on_disk(spark)
    assert sorted(t.name.rsplit("-", 1)[0] for t in made[0] - tables) == ["numbered", "suffix-regions", "suffix-spans"]
    assert not made[1] - shuffles
