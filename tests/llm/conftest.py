"""Small tables that hold nulls, empty and long texts, repeated rows and columns with clashing names."""

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """``(doc_id, text)``: plain, near and exact copies, odd ones."""
    rng = random.Random(5)
    base = [words(rng, rng.randint(1, 120)) for _ in range(40)]
    rows = list(enumerate(base))
    rows += [(100 + i, base[i]) for i in range(6)]
    rows += [(200 + i, base[i] + " tail") for i in range(8)]
    rows += [(300, None), (301, ""), (302, "  \n\t "), (303, "one"), (304, "Two Words"), (305, "ÄÖ ß é 日本 🎉 x")]
    rows += [(306, words(rng, 30_000)), (307, "x" * 60_000), (303, "one"), (None, base[0]), (None, None)]
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i, t, "en", "src0", len(t or "")) for i, t in texts]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
