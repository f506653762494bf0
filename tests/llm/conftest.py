import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, bucket string, keys string, g string"


@pytest.fixture(scope="session")
def make(spark):
    """A documents table with extra columns that clash with names used inside; null ids and texts, copies, odd texts."""

    def build(texts, more=()):
        rows = [(i, t, "en", "src%d" % (i % 3), None if t is None else len(t), "x", "y", "z") for i, t in enumerate(texts)]
        return spark.createDataFrame([*rows, *more], SCHEMA)

    return build


@pytest.fixture(scope="session")
def prose():
    """Sentences of an invented language by a seed."""

    def build(n, seed, words=2000):
        r = random.Random(seed)
        return " ".join("w%d" % min(r.randrange(words), r.randrange(words)) for _ in range(n))

    return build


@pytest.fixture(scope="session")
def corpus(prose):
    base = [prose(120 + 7 * i, i) for i in range(24)]
    passage = prose(70, 999)
    texts = [*base, base[3], base[3], base[5].replace("w1", "q1", 1), "", None, "   \n\t", "One", "x" * 5000, passage + " " + base[7], base[8] + " " + passage, base[9] + "\n" + base[9], "É ß 漢字 " * 40]
    words = base[10].split()
    words[60] = "changed"
    return [*texts, " ".join(words), prose(30_000, 77)]
