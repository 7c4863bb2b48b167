import pytest

#: Awkward rows: nulls in any column, empty and blank texts, ties, repeated rows.
ROWS = [
    (None, "null id has a text of some words", "en", "s0"),
    (1, None, "en", "s0"),
    (2, "", None, None),
    (3, " \t\n ", "en", "s0"),
    (4, "one", "en", "s0"),
    (5, "12 34 !!", "en", "s0"),
    (6, "the same line\nthe same line\nthe same line", "en", "s0"),
    (6, "the same line\nthe same line\nthe same line", "en", "s0"),
    (7, "ein Satz mit Wörtern über alles und noch mehr", "de", "s1"),
    (8, "the quick brown fox jumps over the lazy dog", "en", None),
    (8, "another text under the same id", "en", None),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def awkward(spark):
    """Awkward rows with a very long text and columns whose names clash with those the operators use inside."""
    rows = [(*r, 7, True, "x") for r in [*ROWS, (9, "word " * 60_000 + "é" * 40_000, "en", "s0")]]
    return spark.createDataFrame(rows, SCHEMA + ", key long, near_keeps boolean, row_key string")


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
