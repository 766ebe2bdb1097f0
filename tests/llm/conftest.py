import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, __id string, body string, fp int, host string, path string, rank int, src string"


@pytest.fixture(scope="session")
def frame(spark):
    """A documents table from (doc_id, text, source) with extra columns of clashing names."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "y", 1, "h", "p", 2, "q") for i, t, s in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd():
    """Nulls, empty and long texts, ties, repeated rows and ids."""
    r = random.Random(5)
    words = [f"w{i}" for i in range(40)] + ["É", "ß.", "the", "|", "$5"]
    say = lambda n: " ".join(r.choice(words) for _ in range(n))
    shared = say(60)
    rows = [(1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (None, say(30), "a"), (4, say(9000), "b"), (5, shared, "b"), (5, shared, "b"), (6, shared, "c"), (7, shared + " tail", "c"), (7, say(12), None)]
    rows += [(10 + i, "\n".join(say(r.randint(0, 25)) for _ in range(r.randint(1, 9))), r.choice("abc")) for i in range(40)]
    return rows
