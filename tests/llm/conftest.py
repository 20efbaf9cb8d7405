import random

import pytest
from pyspark.sql import functions as F

LONG_TEXT = "word " * 30_000 + "\n" + "x" * 50_000

#: Nulls in any column, empty and very long texts, repeated rows and ties.
ODD = [
    (1, "Plain words of one line.\nAnd then another line of words here.", "en", "a", 10),
    (1, "Plain words of one line.\nAnd then another line of words here.", "en", "a", 10),
    (2, None, "en", "a", None),
    (3, "", None, "b", 0),
    (4, " \n\t \n", "en", None, 5),
    (5, LONG_TEXT, "en", "c", len(LONG_TEXT)),
    (None, "no identifier at all, but words", "en", "a", 3),
    (7, "äöü ßé 漢字 𝒳  nbsp em\x0bvt\x0cff", "de", "c", 9),
    (8, "Plain words of one line.", "en", "a", 10),
]
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def odd(spark):
    """Odd documents with further columns, some named as results are."""
    return spark.createDataFrame(ODD, SCHEMA).withColumns({"score": F.lit("s"), "n_tokens": F.lit("t"), "kept": F.lit(1), "size": F.lit(0), "ids": F.lit(2), "node": F.lit("n")})


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sentences(seed: int, n: int, words: int = 400) -> list[str]:
    r = random.Random(seed)
    return [" ".join(f"w{r.randrange(words)}" for _ in range(r.randrange(5, 40))) for _ in range(n)]


@pytest.fixture
def rng():
    return random.Random(5)
