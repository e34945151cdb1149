import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, key string, row string, node int, text_hash string, spans string, n int, words int"
PASSAGE = " ".join(f"w{i}" for i in range(70))


def odd_rows():
    """Null and empty texts, copies, repeated rows and ids, null ids, ties, one long text."""
    near = PASSAGE.replace("w35", "other")
    return [
        (1, None), (2, ""), (3, PASSAGE), (4, PASSAGE), (4, PASSAGE), (5, near), (None, PASSAGE), (6, "a " * 300), (7, "é" * 500),
        (8, " ".join(f"x{i % 4001}" for i in range(9000))), (9, "one two"), (9, "Three, four five; six"), (10, " \t\n "), (11, "one two"),
    ]


@pytest.fixture
def documents(spark):
    """Rows (doc_id, text) with extra columns whose names clash with inner ones."""
    def make(rows, parts=2):
        full = [(d, t, "en", "k", "r", 1, "h", "s", 2, 3) for d, t in rows]
        return spark.createDataFrame(full, SCHEMA).repartition(parts)
    return make


@pytest.fixture
def odd(documents):
    return documents(odd_rows())


def random_texts(seed, n, letters, longest, glue=" "):
    rng = random.Random(seed)
    return [(i, glue.join(rng.choice(letters) for _ in range(rng.randrange(longest)))) for i in range(n)]
