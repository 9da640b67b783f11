import random

import pytest
from llm_texts import prose


@pytest.fixture()
def rng():
    return random.Random(11)


@pytest.fixture()
def odd_documents(spark, rng):
    """Nulls in every column, empty and blank texts, a very long one, repeated rows, ties, and a column that clashes with internal names."""
    long = prose(rng, 30_000)
    rows = [
        (1, prose(rng, 60), "en", "a"), (2, None, "en", "a"), (3, "", None, None), (4, " \t\n", "de", "b"), (5, long, "en", "b"),
        (6, "é" * 500, "fr", None), (7, prose(rng, 40), None, "c"), (7, prose(rng, 40), "en", "c"), (None, prose(rng, 50), "en", "a"),
        (None, None, None, None), (8, "one two", "en", "a"), (8, "one two", "en", "a"),
    ]
    rows += [(10 + i, rows[0][1], "en", "a") for i in range(5)]
    return spark.createDataFrame([(*r, i, "x") for i, r in enumerate(rows)], "doc_id long, text string, lang string, source string, size int, component_id string")


@pytest.fixture()
def no_documents(odd_documents):
    return odd_documents.limit(0)
