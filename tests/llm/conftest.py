import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, n_words long, row long, score double, kept boolean, tokens long, spans string, id long"


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls in every column, empty, long and repeated texts, and columns named like made ones."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["of", "the", "blue", "house", "was", "seen", "by", "a", "man"]) + str(rng.randrange(900)) for _ in range(20_000))
    extra = (7, 7, 0.5, None, 3, "x", 9)
    rows = [
        (1, "Released under the MIT License. Call +1 (424) 555-6469 or write to a.b@mail.example.com", "en", "src1", 5, *extra),
        (2, None, "en", "src1", None, *extra), (3, "", None, "src2", 0, *extra), (None, "one two three", "en", None, 1, *extra),
        (4, long, "en", "src1", 9, *extra), (5, "same row here", "fr", "src2", 1, *extra), (5, "same row here", "fr", "src2", 1, *extra),
        (6, "same row here", "fr", "src2", 1, *extra), (7, " \n\t ", "en", "src1", 1, *extra),
        (8, "x", None, None, None, None, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)
