"""What several tests of the training-data operators use."""

import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs(spark):
    """A function from (doc_id, text) pairs to a table with more columns, some named like results."""

    def build(rows, partitions=3):
        full = [(i, t, "en", "src", "x", None, 7) for i, t in rows]
        schema = "doc_id bigint, text string, lang string, source string, kept string, spans string, n_words int"
        return spark.createDataFrame(full, schema).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def prose():
    """A function that makes words, the same for the same seed."""
    import random

    def build(n, seed=0, kinds=400):
        r = random.Random(seed)
        words = ["".join(r.choice("abcdefghilmnorstu") for _ in range(r.randint(2, 8))) for _ in range(kinds)]
        return [r.choice(words) for _ in range(n)]

    return build
