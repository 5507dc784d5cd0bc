import random

import pytest
from samples import SCHEMA, words

@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and blank texts, one very long text, ties, repeated rows."""
    rng = random.Random(1)
    base = words(rng, 80)
    rows = [
        (1, None, "en", "a", 3), (2, "", "en", "a", 0), (3, " \n\t \n", None, None, None),
        (4, base, "en", "a", 9), (4, base, "en", "a", 9), (5, base, "fr", "b", 1), (None, base, "fr", None, 1),
        (None, None, None, None, None), (6, base.upper(), "en", "b", 2), (7, "one two", "en", "b", 7),
        (7, "one two three", "en", "b", 7), (8, words(rng, 120_000), "de", "c", 5), (9, "!!! ... ???", "de", "c", 5),
        (10, "ünïcode ßtraße " * 20, "de", "c", 5), (11, "x" * 3_000_000, "de", "c", 5),
    ]
    return rows


@pytest.fixture()
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA)


@pytest.fixture()
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture()
def folder(spark, tmp_path):
    return f"file://{tmp_path}/work"

