"""Rows and fixtures that the test modules of this folder import."""

import pytest

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"

#: Rows that every operator must take: no id, no text, blank and one-word texts, ties, repeated rows, a very long text.
LONG = " ".join(f"word{i % 977} and {i}" for i in range(30_000))
PASSAGE = "the quick brown fox jumps over the lazy dog while seven wizards quietly examine boxes of jam and " * 3
ODD_ROWS = [
    (1, PASSAGE + "first end", "en", "a", 0),
    (2, "start " + PASSAGE, "en", "a", 0),
    (2, "start " + PASSAGE, "en", "a", 0),
    (3, None, None, None, None),
    (4, "", "en", "a", 0),
    (5, " \t\n ", "en", None, 0),
    (6, "word", "de", "a", None),
    (None, PASSAGE, "fr", "b", 1),
    (None, None, None, None, None),
    (7, LONG, "en", "a", 1),
    (8, LONG, "en", "a", 1),
    (9, "été à l'école — naïve 日本語 👍 " * 20, "fr", "a", 1),
    (10, "write to jane.doe@mail.example.com or +1 (499) 555-6503, card 4111 1111 1111 1111, host 10.0.0.255", "en", "a", 1),
]


@pytest.fixture(scope="session")
def odd(spark):
    """The odd rows, with extra columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame(ODD_ROWS, SCHEMA)
    names = "block n_words kept bucket rep piece start length score accepted base spans row term code"
    return df.select("*", *(F.lit(7).alias(n) for n in names.split()))


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
