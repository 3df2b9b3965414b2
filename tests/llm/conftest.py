import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double"


def words(rng, n):
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bdfgklmnprst") for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, ties and repeated rows, and an extra column of a clashing name."""
    rng = random.Random(11)
    rows = [(i, words(rng, rng.randint(6, 60)), rng.choice(["en", "de"]), "s", 0, 0.5) for i in range(40)]
    base = words(rng, 120).split()
    for i in range(40, 52):  # near copies
        w = list(base)
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = "edit"
        rows.append((i, " ".join(w), "en", "s", 0, 0.5))
    rows += [(60, None, None, None, None, None), (61, "", "en", "s", 0, 0.5), (62, "", "en", "s", 0, 0.5), (63, "ab ac", "en", "s", 0, 0.5), (64, words(rng, 9000), "en", "s", 0, 0.5), (65, rows[3][1], "de", "t", 0, 0.5), (66, "  \n\t ", "en", "s", 0, 0.5)]
    rows.append(rows[5])  # a repeated row
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
