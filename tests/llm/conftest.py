from __future__ import annotations

import random

import pytest

SYLLABLES = ["an", "be", "co", "du", "el", "fi", "gor", "hal", "is", "ju", "ka", "lem", "mon", "nor"]


def words(draw: random.Random, n: int) -> list[str]:
    return ["".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 3))) for _ in range(n)]


@pytest.fixture(scope="session")
def prose():
    """A function that gives n words of invented prose for a seed."""
    return lambda seed, n: " ".join(words(random.Random(seed), n))


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def docs(spark):
    """A documents table from (id, text) pairs, in several partitions."""

    def make(rows):
        full = [(i, t, "en", "src0", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make
