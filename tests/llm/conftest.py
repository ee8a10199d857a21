import random

import pytest

#: names that the operators use for their own columns
CLASHING = ("id", "version", "pos", "h", "c", "batch", "n", "band", "row", "text2", "key", "lines", "spans", "score", "component", "kept")


def prose(rng, n, words=400):
    return " ".join(rng.choice(["w", "x", "y", "z"]) + str(rng.randrange(words)) for _ in range(n))


@pytest.fixture(scope="session")
def docs_schema():
    return "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHING)


@pytest.fixture(scope="session")
def edge_rows():
    """Nulls in any column, empty, blank and very long texts, repeated rows,
    one id with two texts, copies without an id."""
    rng = random.Random(4)
    long = "\n".join(prose(rng, 40) + "." for _ in range(900))
    rest = ("a",) * len(CLASHING)
    nothing = (None,) * len(CLASHING)
    shared = "This very line stands in several documents. " + prose(rng, 60)
    return [
        (1, None, "en", "s", 3, *rest), (2, "", None, None, None, *nothing), (3, " \t\n ", "en", "s", 1, *rest),
        (4, long, "en", "s", 9, *rest), (5, long, "en", "s", 9, *rest), (5, long, "en", "s", 9, *rest),
        (6, shared + "\nOne line of its own here.", "de", "s", 9, *rest), (6, "Another text with the same id as one before it.\n" + shared, "de", "s", 9, *rest),
        (None, shared, "en", None, None, *nothing), (None, shared, "en", None, None, *nothing), (None, None, None, None, None, *nothing),
        (-7, "x" * 50_000, "en", "s", 1, *rest), (8, "é" * 3000 + " ▁ \u2028 日本語 🎉\r\n\x0b", "fr", "s", 1, *rest),
    ]


@pytest.fixture()
def edge_docs(spark, edge_rows, docs_schema):
    return spark.createDataFrame(edge_rows, docs_schema)


@pytest.fixture()
def no_docs(spark, docs_schema):
    return spark.createDataFrame([], docs_schema)
