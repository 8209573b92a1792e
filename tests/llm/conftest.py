import random

import pytest

DOCS = (
    "doc_id long, text string, lang string, source string, n_chars long, id long, b int, k int, "
    "blob string, m array<string>, value string, train boolean"
)


@pytest.fixture
def docs_of(spark):
    """Documents with more columns, named as the operators name theirs."""

    def make(rows):
        full = [(i, t, "xx", None, None, 7, 1, 2, "b", ["m"], "v", None) for i, t in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture
def messy_rows():
    """Nulls, empty, blank and very long texts, repeated rows and ids."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = say(120)
    return [
        (1, base),
        (2, base),
        (2, base),
        (3, "Once " + base[:400] + " more"),
        (3, "same id, other text"),
        (4, None),
        (5, ""),
        (6, " \n\t "),
        (7, "... 12 !!"),
        (None, base),
        (None, None),
        (8, say(30_000)),
        (9, "a" * 5_000),
        (10, "b" + "a" * 400),
        (11, base.replace(words[3], "zzz") + " end"),
    ]
