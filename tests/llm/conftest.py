import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, fp string, id string"


def odd_rows():
    """Nulls, empty and long texts, ties and repeated rows, with extra columns of clashing names."""
    rnd = random.Random(3)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "ne", "ru") for b in ("ba", "do", "fi", "ge", "shu")]
    plain = [" ".join(rnd.choices(vocabulary, k=80)) + ".\n" + " ".join(rnd.choices(vocabulary, k=30)) for _ in range(12)]
    long = " ".join(rnd.choices(vocabulary, k=30_000))
    texts = [*plain, plain[0], plain[1].upper(), None, "", "   \n\t ", "word", long, "a\nb\n\nthe same long line\nb", "x\nThe Same Long Line  ", "été \U0001f600 中文 \x1c  "]
    rows = [(i, t, "en" if i % 2 else None, None, len(t) if t else None, "clash", "clash") for i, t in enumerate(texts)]
    return [*rows, rows[3], rows[3], (None, plain[2], "en", "s", 1, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark):
    return spark.createDataFrame(odd_rows(), COLUMNS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, int(i % 4 != 0), int(i % 3 == 0)) for i in range(22)] + [(3, 0, 0), (None, 1, 1), (5, None, None)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def no_labels(spark):
    return spark.createDataFrame([], "doc_id long, quality int, toxic int")
