"""Tables with every odd case the operators must bear."""

from __future__ import annotations

import pytest

PROSE = "the quick brown fox jumps over the lazy dog and runs far away into the dark green forest where nobody lives now"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """documents with nulls in every column, empty and blank texts, ties, copies, a long text and clashing extra columns."""
    long = " ".join(f"w{i * 7919 % 5003}" for i in range(60_000))
    rows = [
        (1, PROSE, "en", "a"), (2, PROSE, "en", "a"), (3, PROSE + " indeed", None, None), (4, None, "en", "a"), (5, "", "en", None), (6, " \t\n ", None, "b"),
        (7, "one", "en", "b"), (8, "One", "en", "b"), (9, "two words", "fr", "b"), (10, long, "en", "a"), (11, long + " tail", "en", "c"),
        (12, "naïve café ▁ déjà  vu x y", "fr", "c"), (13, "\U0001f600 \U0001f600 � \x00 end", "fr", "c"), (14, "a\na\na\n\nb\n", "en", "c"), (15, "x" * 200_000, None, "c"),
        (16, " ".join(["spam eggs ham"] * 30), "en", "a"), (17, "<|endoftext|> <s> </s> <unk> [UNK]", "en", "a"),
    ]
    return spark.createDataFrame([(*r, "z", 1, len(r[1] or ""), True) for r in rows], "doc_id long, text string, lang string, source string, size string, component_id int, n_chars long, kept boolean")


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
