import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, row string, size long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, and columns that clash."""
    long = " ".join(f"word{i % 997} and" for i in range(40_000))
    rows = [
        (1, "plain words of a clean text that says nothing bad at all", "en", "a", 10, 0.5, "x", 1),
        (1, "plain words of a clean text that says nothing bad at all", "en", "a", 10, 0.5, "x", 1),
        (2, "plain words of a clean text that says nothing bad at all", "en", "b", 10, None, None, None),
        (3, None, "en", "a", None, None, None, None),
        (4, "", None, None, 0, None, None, None),
        (5, " \t\n ", "de", "", 4, None, None, None),
        (None, "a text of a row without an id that is its own", "en", "a", 5, None, None, None),
        (None, None, None, None, None, None, None, None),
        (6, long, "en", "hot", len(long), None, None, None),
        (7, long + " end", "en", "hot", len(long) + 4, None, None, None),
        (8, "écrivez à jean@example.org ou +33 1 23 45 67 89", "fr", "hot", 47, None, None, None),
        (9, "🙂 mail me@x.y.z now", "en", "hot", 20, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
