"""Operator 7: licence scan by Dice coefficient over word bigrams.

DataFrame functions only, one narrow pass.  A text's units are its lines, and,
where they span several lines, its paragraphs and the whole text.  A unit is
normalised (lower case, every run of other than letters and digits one space)
and compared, as a bag of word bigrams, with each template:
``2 |A and B| / (|A| + |B|)``.  The size of a bag is the number of words less
one, so before any bigram is built, sizes alone prune: a coefficient of ``t``
needs ``|A|`` between ``t / (2 - t) |B|`` and ``(2 - t) / t |B|``.  Of the sizes
that are left, a unit must hold one of a few bigrams of the template, as it
needs ``t / (2 - t) |B|`` of all.  Both bounds lose nothing.  For full texts
(``license_texts``, read by the driver) the second bound counts: no more distinct
bigrams of the text may be absent than the coefficient lets bigrams be absent.

A document's licence is that of its best unit (ties: the template listed
first); ``n_matches`` counts units at or above the threshold.

Defined results: null, empty and unlicensed texts have null licence, dice 0 and
no matches; repeated rows are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache, reduce
from operator import or_
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from signalmesh.llm.common import table, texts

THRESHOLD = 0.75
#: Usual notices and short licences, by SPDX identifier.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
            "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
            "is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
            "included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                   "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
                "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
            "provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
)


@lru_cache(maxsize=1)
def full_texts() -> tuple[tuple[str, str], ...]:
    """Whole licences, by SPDX identifier."""
    return tuple((f.stem, f.read_text()) for f in sorted((Path(__file__).parent / "license_texts").glob("*.txt")))


def bag(template: str) -> list[str]:
    """Numbered word bigrams, so that a repeated one counts as often as it occurs."""
    words = re.findall(r"[a-z0-9]+", template.lower())
    seen: Counter = Counter()
    out = []
    for pair in zip(words, words[1:]):
        seen[pair] += 1
        out.append(f"{pair[0]} {pair[1]} {seen[pair]}")
    return out


def _bounds(size: int, threshold: float) -> tuple[float, float]:
    return threshold / (2 - threshold) * size, (2 - threshold) / threshold * size


def told(grams: list[str], threshold: float) -> list[str]:
    """Bigrams of a template of which every unit near enough holds one.

    A coefficient of ``t`` needs ``t / (2 - t)`` of the template's bigrams, so any
    set of more than the rest will do; the longest are the rarest.
    """
    need = math.ceil(_bounds(len(grams), threshold)[0] - 1e-9)
    longest = sorted(grams, key=lambda g: (-len(g), g))[: len(grams) - need + 1]
    return list(dict.fromkeys(g.rsplit(" ", 1)[0] for g in longest))


def units(plain: Column) -> Column:
    """Lines, and paragraphs and the whole where they have several lines."""
    lines = F.split(plain, "\n")
    several = F.contains(F.trim(plain), F.lit("\n"))
    paragraphs = F.filter(F.split(plain, r"\n[ \n]*\n"), lambda p: F.contains(F.trim(p), F.lit("\n")))
    larger = F.transform(F.array_distinct(F.concat(paragraphs, F.array(plain))), lambda p: F.replace(p, F.lit("\n"), F.lit(" ")))
    return F.transform(F.when(several, F.concat(lines, larger)).otherwise(lines), lambda u: F.trim(F.regexp_replace(u, "  +", " ")))


def pairs(plain: Column) -> Column:
    """Each unit's word bigrams."""
    words = F.transform(plain, lambda u: F.split(u, " "))
    return F.transform(words, lambda w: F.zip_with(F.slice(w, F.lit(1), F.size(w) - 1), F.slice(w, F.lit(2), F.size(w) - 1),
                                                   lambda a, b: F.concat_ws(" ", a, b)))


def bags(paired: Column) -> Column:
    """Bigrams of each unit numbered; in order, so that equal ones are side by side."""
    return F.transform(F.transform(paired, lambda g: F.array_sort(g)), lambda g: F.transform(g, lambda x, i: F.concat_ws(
        " ", x, i + 2 - F.array_position(g, x))))


def listed(grams: list[str]) -> Column:
    """An array of strings as one literal."""
    return F.split(F.lit("\n".join(grams)), "\n")


def scan_licenses(docs: DataFrame, threshold: float = THRESHOLD, templates: tuple[tuple[str, str], ...] = TEMPLATES,
                  doc_id: str = "doc_id", text: str = "text", full: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """One row per input row: ``doc_id, license, dice, n_matches``."""
    full = full_texts() if full is None else full
    wanted, whole = [bag(t) for _, t in templates], [bag(t) for _, t in full]

    def candidate(x: Column) -> Column:
        fits = [x["size"].between(*_bounds(len(b), threshold)) & reduce(or_, [F.contains(x["unit"], F.lit(g)) for g in told(b, threshold)])
                for b in wanted]
        return reduce(or_, fits)

    def sized_as_whole(x: Column) -> Column:
        return reduce(or_, [x["size"].between(*_bounds(len(b), threshold)) for b in whole], F.lit(False))

    def whole_candidate(grams: Column) -> Column:
        fits = []
        for b in whole:
            least, most = _bounds(len(b), threshold)
            distinct = sorted({g.rsplit(" ", 1)[0] for g in b})
            fits.append(F.size(grams).between(least, most)
                        & (F.size(F.array_intersect(grams, listed(distinct))) >= len(distinct) - (len(b) - math.ceil(least - 1e-9))))
        return reduce(or_, fits, F.lit(False))

    def scored(grams: Column) -> Column:
        return F.array_max(F.array(*[
            F.struct(F.when(F.size(grams).between(*_bounds(len(b), threshold)),
                            F.size(F.array_intersect(grams, listed(b))) * 2.0 / (F.size(grams) + len(b))).otherwise(0.0).alias("dice"),
                     F.lit(-k).alias("place")) for k, b in enumerate(wanted + whole)]))

    names = F.array(*[F.lit(name) for name, _ in (*templates, *full)])
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    best = F.array_max("matches")
    return (texts(docs, doc_id, text).select("doc_id", plain.alias("plain")).withColumn("units", units(F.col("plain")))
            .withColumn("sized", F.transform("units", lambda u: F.struct(u.alias("unit"), (F.size(F.split(u, " ")) - 1).alias("size"))))
            .withColumn("noticed", F.filter("sized", candidate))
            .withColumn("others", pairs(F.transform(F.filter("sized", lambda x: sized_as_whole(x) & ~candidate(x)), lambda x: x["unit"])))
            .withColumn("bags", bags(F.concat(pairs(F.transform("noticed", lambda x: x["unit"])), F.filter("others", whole_candidate))))
            .withColumn("matches", F.filter(F.transform("bags", scored), lambda m: m["dice"] >= threshold))
            .select("doc_id", F.when(F.size("matches") > 0, F.element_at(names, 1 - best["place"])).alias("license"),
                    F.coalesce(best["dice"], F.lit(0.0)).alias("dice"), F.size("matches").cast("long").alias("n_matches")))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences of all ``documents``."""
    return scan_licenses(table(spark, sf_dir, "documents"))
