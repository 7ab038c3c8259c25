import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
EXTRA = ", kept string, keep_id string, score string, position string, n_words string, class_id string, rule string, lang_pred string, group_size string, verdict string, host string, word_distance string, Slot string"


def prose(n, seed=0, words=None):
    rng = random.Random(seed)
    words = words or "the of and to in a is that it was for on are as with river stone window carry bright morning paper garden silent travel".split()
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty, blank and very long texts, repeated rows and ids, a column for each name that operators add."""
    long = prose(40_000, 1)
    base = prose(120, 2)
    rows = [
        (1, base, "en", "a", 5), (1, base, "en", "a", 5), (2, base + "  \n", "en", "b", 5), (3, None, None, None, None), (4, "", "de", "a", 0),
        (5, " \t\n\v\f\r ", "fr", "b", 3), (None, base, None, "a", None), (None, "short text", "en", None, 10), (6, long, "en", "a", len(long)),
        (7, "Ünïcödé 漢字 👍 x", "zz", "c", 9), (8, "!!! ### ***", "en", "c", 3), (9, prose(200, 3), "en", "c", 3), (10, prose(199, 3), "en", "c", 3), (11, "x" * 100_000, "en", "c", 3),
    ]
    df = spark.createDataFrame(rows, DOCS)
    for c in EXTRA.split(", ")[1:]:
        df = df.selectExpr("*", f"'own' as `{c.split()[0]}`")
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
