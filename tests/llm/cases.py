"""Small tables with the awkward rows that every operator must take."""

from __future__ import annotations

DOCS = "doc_id long, text string, lang string, source string, n_chars long, Shard string, `key` string, n int"

LONG = " ".join(f"word{i % 997}x{i}" for i in range(12_000))
PLAIN = "the quick brown fox jumps over the lazy dog and runs far away from the old red barn by the river "


def awkward_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, PLAIN * 8, "en", "a", 10, "x", "k", 1),
        (1, PLAIN * 8, "en", "a", 10, "x", "k", 1),  # a repeated row
        (2, PLAIN * 8, "en", None, None, None, None, None),  # the same text under another id
        (2, "another text under the same id", "en", "a", 5, "x", "k", 1),
        (3, None, None, None, None, None, None, None),
        (4, "", "en", "b", 0, "x", "k", 1),
        (5, " \n\t ", "fr", "b", 3, "x", "k", 1),
        (None, "a text without an id " * 5, "en", "a", 7, "x", "k", 1),
        (None, None, None, None, None, None, None, None),
        (7, LONG, "en", "a", len(LONG), "x", "k", 1),
        (8, "!!! 123 ???", "de", "c", 11, "x", "k", 1),
        (9, "é ñ ü 漢字 🙂 " * 3, "es", "c", 20, "x", "k", 1),
    ]
    return spark.createDataFrame(rows, DOCS)


def no_docs(spark):
    return spark.createDataFrame([], DOCS)
