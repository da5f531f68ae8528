import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long, taken string, label string"
LONG = "lorem ipsum " * 40_000


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and long texts, copies, repeated rows, columns with clashing names."""
    rows = [
        (1, "the cat sat on the mat and looked at the dog", "en", "a"),
        (2, "the cat sat on the mat and looked at the dog", "en", "b"),
        (3, None, "en", None),
        (4, "", None, "a"),
        (5, " \t\n", "fr", None),
        (6, LONG, "la", "a"),
        (7, "Zwei Worte", "de", "c"),
        (7, "Zwei Worte", "de", "c"),
        (None, "an id that is missing", "en", "a"),
        (9, "12345 !!!", None, "c"),
    ]
    return spark.createDataFrame([(*r, 0, "x", "y") for r in rows], DOC)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOC)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
