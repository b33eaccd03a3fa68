import pytest

#: Texts of the edge cases: null, empty, blank, ties, repeated rows, long words, other scripts.
TEXTS = [
    (1, "The cat sat on the mat and looked at the moon."),
    (2, "The cat  sat on the mat\nand looked at the moon."),
    (3, None),
    (4, ""),
    (5, " \t\n"),
    (6, "MIT License. Released under the MIT license; mit-license"),
    (7, "word " * 5000),
    (8, "été naïve 日本語 \U0001f600 ǅ"),
    (9, "The cat sat on the mat and looked at the moon."),
    (9, "The cat sat on the mat and looked at the moon."),
    (None, "A row without an id"),
    (11, "x" * 70000),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, fp long, size int, norm string, component_id string"


def rows(texts, sources=("a", "b", None)):
    return [(i, t, "en", sources[k % len(sources)], len(t or ""), 7, 8, "clash", "clash") for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="session")
def docs(spark):
    """Edge cases, with extra columns whose names clash with those of results."""
    return spark.createDataFrame(rows(TEXTS), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def make(spark):
    return lambda texts, **k: spark.createDataFrame(rows(texts, **k), SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def edge_texts():
    return TEXTS
