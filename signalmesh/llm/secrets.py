"""Operator 5: secret scan. A keyword automaton finds where to look, anchored patterns look there, checksums confirm.

One pass of Aho-Corasick over a text finds every keyword of every kind (and,
for hexadecimal runs, which have no keyword, every four hexadecimal digits in a
row, built by rule).  Patterns are only ever matched *at* such a hit, never
searched, so time stays linear in the text.  A match must begin at its first
keyword, hits are taken in order of their start, and hits inside the kind's
last match are skipped: that is the leftmost non-overlapping scan of the whole
pattern.  (A kind with a checksum skips only what holds.)

Kinds, in this order: ``assign`` (a secret's name, ``:`` or ``=``, a value of 12
or more), ``access`` (AKIA keys of 18 or more), ``hex`` (runs of 16 or more).
Added by the method, where a checksum inside the token proves it: ``github``
(``ghp_ gho_ ghu_ ghs_ ghr_``) and ``npm`` tokens end in the base-62 CRC-32 of
their body; ``mod97`` are account numbers (IBAN) of their country's length whose
check digits hold.  A number that fails is not skipped: one may begin inside it.

Defined results: null text is empty; documents without secrets have counts 0,
an empty ``spans`` and the digest of the empty string; repeated rows are scanned
each; an empty table gives no rows.  Spans are in code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import ASCII_LOWER, ASCII_UPPER, documents, flushed, table, texts

#: Kinds in order, their keywords and patterns.
KINDS = ("assign", "access", "hex", "github", "npm", "mod97")
BASE = KINDS[:3]
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
GITHUB = re.compile(r"gh[pousr]_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
NPM = re.compile(r"npm_([0-9A-Za-z]{30})([0-9A-Za-z]{6})(?![0-9A-Za-z])")
#: Characters of a country's account numbers.
IBAN_LENGTHS = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20,
                "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}
MOD97 = re.compile("|".join(rf"{c}[0-9]{{2}}(?:\x20?[A-Z0-9]){{{n - 4}}}(?![A-Z0-9])" for c, n in IBAN_LENGTHS.items()))
DIGITS62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

SCHEMA = pa.schema([("doc_id", pa.int64()), ("kind", pa.list_(pa.string())), ("start", pa.list_(pa.int64())), ("end", pa.list_(pa.int64()))])


def crc62(body: str) -> str:
    """CRC-32 in six base-62 digits."""
    n, out = zlib.crc32(body.encode()), ""
    while n:
        n, d = divmod(n, 62)
        out = DIGITS62[d] + out
    return out.rjust(6, "0")


def mod97(number: str) -> bool:
    plain = number.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in plain[4:] + plain[:4])) % 97 == 1


#: kind -> (pattern, test of a match)
RULES = {
    "assign": (ASSIGN, lambda m: m.end(1) - m.start(1) >= 12),
    "access": (ACCESS, lambda m: m.end() - m.start() >= 18),
    "hex": (HEX, lambda m: m.end() - m.start() >= 16),
    "github": (GITHUB, lambda m: crc62(m[1]) == m[2]),
    "npm": (NPM, lambda m: crc62(m[1]) == m[2]),
    "mod97": (MOD97, lambda m: mod97(m[0])),
}


@lru_cache(maxsize=1)
def automatons():
    """Keywords of names in any case (matched on lower case) and of the others."""
    import ahocorasick

    def built(words: dict[str, str]):
        a = ahocorasick.Automaton()
        for word, kind in words.items():
            a.add_word(word, (len(word), kind))
        a.make_automaton()
        return a

    exact = {"".join(p): "hex" for p in product("0123456789abcdef", repeat=4)}
    exact |= {"AKIA": "access", "npm_": "npm"} | {f"gh{c}_": "github" for c in "pousr"}
    exact |= {f"{c}{d}": "mod97" for c in IBAN_LENGTHS for d in range(10)}
    return built({n: "assign" for n in NAMES}), built(exact)


LOWER = str.maketrans(ASCII_UPPER, ASCII_LOWER)


def _ascii_lower(text: str) -> str:
    """A-Z in lower case, other characters and all places as they were."""
    return text.lower() if text.isascii() else text.translate(LOWER)


def spans(text: str) -> list[tuple[int, str, int]]:
    """``(start, kind, end)`` by start, then kind."""
    names, exact = automatons()
    hits = [(end + 1 - n, kind) for end, (n, kind) in names.iter(_ascii_lower(text))] if text else []
    hits += [(end + 1 - n, kind) for end, (n, kind) in exact.iter(text)] if text else []
    hits.sort()
    last, found = dict.fromkeys(KINDS, 0), []
    for start, kind in hits:
        if start < last[kind]:
            continue
        pattern, holds = RULES[kind]
        m = pattern.match(text, start)
        if m and holds(m):
            found.append((start, kind, m.end()))
        if m and (kind in BASE or holds(m)):
            last[kind] = m.end()
    found.sort(key=lambda f: (f[0], KINDS.index(f[1])))
    return found


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows():
        for doc_id, text in documents(batches, "doc_id", "text"):
            found = spans(text)
            yield doc_id, [k for _, k, _ in found], [s for s, _, _ in found], [e for _, _, e in found]

    yield from flushed(rows(), SCHEMA, 5000)


def scan_secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: ``doc_id`` and the parallel arrays ``kind, start, end``."""
    return texts(docs, doc_id, text).mapInArrow(_scan, "doc_id long, kind array<string>, start array<long>, end array<long>")


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all ``documents``."""
    base = F.array(*map(F.lit, BASE))
    found = scan_secrets(table(spark, sf_dir, "documents")).withColumn(
        "found", F.transform(F.arrays_zip("kind", "start", "end"), lambda x: F.struct(
            x["kind"].alias("kind"), F.concat_ws(":", x["kind"], x["start"], x["end"]).alias("span"))))
    of_base = F.filter("found", lambda x: F.array_contains(base, x["kind"]))
    spans_of = lambda c: F.array_join(F.transform(c, lambda x: x["span"]), ",")
    count = lambda kind: F.size(F.filter("kind", lambda k: k == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, BASE),
                        F.sha2(spans_of(of_base), 256).alias("base_sha256"), spans_of(F.col("found")).alias("spans"))
