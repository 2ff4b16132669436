"""Documents with what operators must stand: nulls, empty and odd texts, ties, repeated rows, extra columns."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, n int, key string, part string, q string, h string, component string"


def make(spark, rows):
    """A documents table of (doc_id, text) with extra columns whose names operators use inside."""
    full = [(i, t, "en", "s", None if t is None else len(t), "x", 1, "k", "p", "q", "h", "c") for i, t in rows]
    return spark.createDataFrame(full, SCHEMA)


def sentence(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(n))


def odd_rows(rng=None):
    """Near and exact copies, shared passages, long and short texts, nulls and repeated rows."""
    rng = rng or random.Random(5)
    base = sentence(rng, 120)
    shared = sentence(rng, 50)
    words = base.split()
    rows = [(0, None), (1, ""), (2, "  \n\t "), (3, "one two"), (4, "one two"), (5, base), (6, base)]
    for k in range(7, 27):  # near copies by degrees
        changed = list(words)
        for _ in range(k - 6):
            changed[rng.randrange(len(changed))] = sentence(rng, 1)
        rows.append((k, " ".join(changed)))
    rows += [(k, sentence(rng, 40) + "\n" + shared + "\n" + sentence(rng, 30)) for k in range(27, 34)]
    rows += [(34, " ".join(["a"] * 100)), (35, sentence(rng, 3000)), (36, "é ü x 日本 😀 " * 20), (37, "ONE two"), (37, "ONE two"), (None, base), (None, None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    return make(spark, odd_rows())


@pytest.fixture(scope="session")
def no_documents(spark):
    return make(spark, [])
