import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"
LEFT, RIGHT = "anon bleti oura shen tion erly whea thor".split(), "dast ing ore eso nth ha re ou".split()


def words(rng, n):
    return " ".join(rng.choice(LEFT) + rng.choice(RIGHT) + rng.choice(LEFT) for _ in range(n))


def sentences(rng, n, least=6, most=14):
    return " ".join(words(rng, rng.randint(least, most)).capitalize() + "." for _ in range(n))


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture
def documents(spark):
    def make(rows):
        """rows: (doc_id, text) or (doc_id, text, source)."""
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", None if r[1] is None else len(r[1])) for r in rows]
        return spark.createDataFrame(full, DOC)

    return make


@pytest.fixture
def empty(spark):
    return spark.createDataFrame([], DOC)
