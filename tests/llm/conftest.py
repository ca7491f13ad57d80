import random

import pytest

WORDS = ["the", "river", "Stone", "walks", "over", "quiet", "fields", "été", "straße", "niño", "漢字", "x1", "blue", "lamp", "runs"]


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """(doc_id, text, lang, source, n_chars): nulls, empty, blank, very long, repeated and tied rows."""
    rng = random.Random(4)
    long = prose(rng, 30_000)
    rows = [(1, "", "en", "a", 0), (2, None, "en", None, None), (3, " \t\n ", None, "a", 4), (4, long, "en", "a", len(long)), (5, long + " more", "fr", "a", len(long) + 5), (None, "a null id here", "en", "a", 14)]
    rows += [(6, "same words in every copy of it", "en", "b", 30)] * 2 + [(7, "same words in every copy of it", "en", "b", 30)]
    return rows + [(i, prose(rng, rng.randrange(1, 80)), rng.choice(["en", "fr"]), "c", 1) for i in range(10, 60)]


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
