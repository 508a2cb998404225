import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty and long texts, copies, repeated rows and clashing columns."""
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "delta", "of", "the", "Émile", "x", "42", "日本"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared = text(120)
    rows = [
        (1, shared, "en", "a", 1),
        (2, shared, "en", "b", 2),
        (2, shared, "en", "b", 2),
        (3, text(30) + " " + shared + " " + text(30), "fr", "a", None),
        (4, None, "en", "a", 0),
        (5, "", "en", None, 0),
        (6, "", None, "a", 0),
        (None, "no id at all", "en", "a", 3),
        (None, shared, "en", "a", 3),
        (7, text(20000), "en", "a", 5),
        (8, "x", "en", "a", 1),
        (9, "x", "en", "a", 1),
        (10, "\n \t ", "en", "a", 1),
        (11, "one two", "de", "c", 1),
        (12, "for " * 3000, "en", "c", 1),
        (13, "for " * 2990, "en", "c", 1),
        (None, None, None, None, None),
    ]
    schema = SCHEMA + ", perplexity string, _tokens int, mix_copy string, _lp int, band int, locator int, tau int"
    return spark.createDataFrame([(*r, "p", 1, "m", 2, 3, 4, 5) for r in rows], schema)


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, data):
    return spark.read.parquet(f"{data}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")
