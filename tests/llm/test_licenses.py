import re
from collections import Counter

import pytest

from signalmesh.llm.licenses import TEMPLATES, THRESHOLD, full_texts, op7_license_scan, scan_licenses
from tests.llm.fixtures import SF2, documents, odd_documents


def bigrams(text):
    words = re.findall(r"[^\W_]+", text.lower())
    return Counter(zip(words, words[1:]))


def brute(text):
    """Every unit against every template, without bounds."""
    plain = re.sub(r"(?:[^\w\n]|_)+", " ", (text or "").lower())
    larger = [p for p in re.split(r"\n[ \n]*\n", plain) if "\n" in p.strip(" ")] + ([plain] if "\n" in (text or "").strip(" ") else [])
    found = []
    for unit in plain.split("\n") + list(dict.fromkeys(larger)):
        a = bigrams(unit)
        best = (0.0, 0)
        for k, (_, t) in enumerate(TEMPLATES):
            b = bigrams(t)
            best = max(best, (2 * (a & b).total() / (a.total() + b.total()), -k))
        if best[0] >= THRESHOLD:
            found.append(best)
    top = max(found, default=(0.0, 0))
    return TEMPLATES[-top[1]][0] if found else None, pytest.approx(top[0]), len(found)


MIT = TEMPLATES[2][1]
HARD = ["released UNDER the   mit-license!", "We are Released under the MIT License. yes", MIT.replace(", ", ",\n"), f"intro\n\n{MIT.replace('the ', 'the' + chr(10))}\n\nend of it all",
        "Licensed under the Apache License, Version 2.0.\nReleased under the MIT License.", "Licensed under under under the the MIT", "\nLicensed under CC BY-NC 4.0.\n",
        "Released under the MIT\nLicense.", "a b\nc d", "license"]


def test_hard_and_odd_texts(spark):
    rows = list(enumerate(HARD)) + [(100 + i, r.text) for i, r in enumerate(odd_documents(spark).collect())]
    got = {r.doc_id: (r.license, r.dice, r.n_matches) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == brute(text), text
    assert got[0][0] == "MIT" and got[2][0] == "MIT" and got[3][0] == "MIT"
    assert scan_licenses(odd_documents(spark).limit(0)).count() == 0


def test_whole_licences(spark):
    rows, want = [], {}
    for name, text in full_texts():
        a, cut = bigrams(text), "\n".join(text.split("\n")[: int(len(text.split("\n")) * 0.9)])
        b = bigrams(cut)
        best = 2 * (a & b).total() / (a.total() + b.total())
        for form, dice in ((text, 1.0), (" ".join(text.split()), 1.0), (cut, best)):
            want[len(rows)] = (name, pytest.approx(dice))
            rows.append((len(rows), form))
        rows.append((len(rows), " ".join(sorted(text.split()))))  # its words, but not its bigrams
        want[len(rows) - 1] = (None, 0.0)
    got = {r.doc_id: (r.license, r.dice) for r in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {n for n, _ in full_texts()} >= {"Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "GPL-2.0", "GPL-3.0", "LGPL-3.0", "MPL-2.0", "CC0-1.0"}
    for i, w in want.items():
        assert got[i] == w, rows[i][1][:80]


def test_query(spark):
    got = {r.doc_id: r for r in op7_license_scan(spark, SF2).collect()}
    rows = documents(spark, SF2).collect()
    assert len(got) == len(rows)
    for r in rows:
        g = got[r.doc_id]
        assert (g.license, g.dice, g.n_matches) == brute(r.text)
        if "Released under the MIT License." in r.text:
            assert g.license
