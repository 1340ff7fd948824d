import random

import pytest


@pytest.fixture
def rng():
    return random.Random(20)


@pytest.fixture(scope="session")
def documents(spark):
    """A table like ``documents`` from texts (ids from 0), or from pairs of id and text, dealt over some partitions."""
    def make(texts, partitions=3, source=None):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        rows = [(i, t, "en", source[k] if source else "s", None if t is None else len(t), "clash", 7) for k, (i, t) in enumerate(rows)]
        frame = spark.createDataFrame(
            rows, "doc_id long, text string, lang string, source string, n_chars long, component_id string, row int")
        return frame.repartition(partitions) if rows else frame
    return make


@pytest.fixture
def vocabulary(rng):
    """Invented words; ``sentence(n)`` draws from them."""
    words = ["".join(rng.choice("abcdefghijklmnoprstuvwé") for _ in range(rng.randint(1, 8))) for _ in range(4_000)]

    def sentence(n):
        return [rng.choice(words) for _ in range(n)]
    return sentence
