import random

import pytest

FIELDS = "doc_id long, text string, lang string, source string, n_chars long, sha string, fp string, places string, score string, part string, near string, doc string, a string, u string, bad string, row string"
EXTRA = ["x"] * 11


def row(doc_id, text, lang="en", source="s1"):
    return (doc_id, text, lang, source, None if text is None else len(text), *EXTRA)


@pytest.fixture(scope="session")
def make(spark):
    """Documents of (doc_id, text[, lang, source]) with further columns named as the operators' own."""
    return lambda rows: spark.createDataFrame([row(*r) for r in rows], FIELDS)


@pytest.fixture(scope="session")
def words():
    """Texts of n random words from a list that makes repeats rare."""
    rng = random.Random(7)
    stock = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 7))) for _ in range(4000)]

    def made(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(stock) for _ in range(n))

    return made


@pytest.fixture(scope="session")
def odd(make, words):
    """Nulls, blanks, repeats, ties, a very long text and one without spaces."""
    base = words(120, 1)
    rows = [
        (1, base), (2, base), (2, base), (3, None), (4, ""), (5, " \t\n\r\x0b\x0c "), (6, base + " tail"), (7, "é" * 50_000), (8, words(60_000, 2)),
        (9, "a a a a a " * 40), (10, "one two"), (None, words(50, 3)), (None, None), (11, base.upper()), (12, "x" * 30 + " " + "y"), (13, "one two"),
    ]
    return make(rows), rows
