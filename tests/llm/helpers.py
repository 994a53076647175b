"""Fixtures that every operator must get through, and brute-force versions."""

import re

DOC = "doc_id long, text string, lang string, source string, n_chars long, score double, label int"
LONG = " ".join(f"word{i % 977} {'ab' * (i % 5)}," for i in range(40_000))


def odd_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, 0.1, 1),
        (1, "alpha beta gamma delta epsilon zeta", "en", "a", 35, 0.1, 1),
        (2, "alpha beta gamma delta epsilon zeta", None, "b", None, None, None),
        (3, None, "en", None, 0, 0.5, 2),
        (None, "no id at all here today", "en", "a", 1, 0.5, 2),
        (4, "", "en", "b", 0, 0.5, 2),
        (5, "  \t\n ", "en", "c", 5, 0.5, 2),
        (6, "one", "en", "c", 3, 0.5, 2),
        (7, LONG, "en", "a", len(LONG), 0.5, 2),
        (8, "x" * 100_000, "en", "d", 100_000, 0.5, 2),
        (9, "Σας ΣΑΣ İstanbul <|endoftext|> 你好 é", "el", "", 9, 0.5, 2),
    ]
    return spark.createDataFrame(rows, DOC)


def no_docs(spark):
    return spark.createDataFrame([], DOC)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")
