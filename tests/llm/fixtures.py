"""Small tables with every awkward row: nulls, empty and blank texts, ties, repeated rows, clashing column names."""

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"

ODD_TEXTS = ["", " ", "\n\n", "a", "a b c", "A B c", "the quick brown fox jumps over the lazy dog again and again",
             "The Quick brown fox jumps over the lazy dog again and again", "été à Zürich, straße!", "x" * 5000, "1.2.3.4 a@b.co +1 234 567 8901",
             "4111 1111 1111 1111", " nbsp space", "tab\tsep\x0bvt\x0cff\rcr", "emoji 😀 text 😀", "\x00nul"]


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet")


def odd_documents(spark):
    """doc_id, text, lang, source and columns named as the operators' own."""
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 4}" if i % 5 else None) for i, t in enumerate(ODD_TEXTS)]
    rows += [(100, None, None, None), (101, None, "de", "s0"), (None, "no id", "en", "s1"), (None, None, None, None)]
    rows += [(6, ODD_TEXTS[6], "en", "s2")] * 2 + [(200, ODD_TEXTS[6], "en", "s2")]
    return spark.createDataFrame([(*r, 1, "k", 2.0, True, "n") for r in rows],
                                 "doc_id long, text string, lang string, source string, size int, kind string, score double, kept boolean, node string").coalesce(2)
