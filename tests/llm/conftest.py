import pytest

LONG = "alpha beta gamma delta " * 40000


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, clashing extra columns."""
    rows = [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, " \t\n ", None, None), (4, LONG, "en", "b"),
        (5, "one two", "de", "a"), (5, "one two", "de", "a"), (None, "one two three four", "fr", "b"),
        (6, "ONE Two three FOUR", "fr", None), (7, "größe ñandú 漢字 \U0001f600 test", "es", "c"),
        (8, "mail x@y.example now", None, "c"), (9, "a", "en", "c"), (9, "b", "en", "c"),
    ]
    extra = [(i, t, lang, src, len(t or ""), -1, "clash", 0.5, 7, "x") for i, t, lang, src in rows]
    return spark.createDataFrame(
        extra, "doc_id long, text string, lang string, source string, n_chars long, size int, spans string, score double, "
               "row long, fp string").repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)
