import random

import pytest


@pytest.fixture(scope="session")
def words():
    rng = random.Random(5)
    return ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(1, 9))) for _ in range(900)]


@pytest.fixture
def prose(words):
    """A text of n words, the same for the same seed."""

    def make(n, seed=0):
        rng = random.Random(seed)
        return " ".join(rng.choice(words) for _ in range(n))

    return make


@pytest.fixture
def documents(spark):
    """Documents of (doc_id, text, source) with columns whose names operators use themselves."""

    def make(rows):
        full = [(d, t, s, 1.0, "x", "y", 7) for d, t, s in rows]
        kinds = (
            "doc_id long, text string, source string, score double, node string, row string, n_chars long"
        )
        return spark.createDataFrame(full, kinds)

    return make
