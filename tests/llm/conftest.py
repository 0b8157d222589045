import random

import pytest

LONG = " ".join(random.Random(7).choices(["river", "stone", "der", "Haus", "été", "mit", "license"], k=40_000))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in any column, empty and very long texts, repeated rows and ids, columns named like the operators' own."""
    rows = [
        (1, "The quick brown fox jumps over the lazy dog, under the MIT License.", "en", 1.0, "a"),
        (1, "The quick brown fox jumps over the lazy dog, under the MIT License.", "en", 1.0, "a"),
        (2, "", "en", None, "b"),
        (3, None, None, 2.0, None),
        (None, "der schnelle braune Fuchs springt über den faulen Hund", "de", 3.0, "c"),
        (None, None, None, None, None),
        (4, LONG, "en", 4.0, "d"),
        (5, "a\tb\n\x00c  d \U0001f600 ﬁ", None, 5.0, "e"),
        (6, "12345 !!! ...", "de", 6.0, "f"),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, row string").selectExpr(
        "*", "score as spans", "score as fp", "row as payload", "score as labels", "row as ids", "score as n_words", "row as media", "score as digest"
    ).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")
