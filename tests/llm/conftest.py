import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, place int, keys string"


@pytest.fixture(scope="session")
def docs_of(spark):
    """Documents with extra columns whose names clash with what operators use inside."""

    def make(rows):
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t), "x", 1, "y") for i, t, lang, src in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Null, empty, blank, one-word, very long and repeated rows, and nulls in other columns."""
    long = " ".join(f"word{i % 977} of the {i}" for i in range(20000))
    return [
        (1, None, "en", "a"), (2, "", None, None), (3, " \t\n ", "en", "b"), (4, "word", None, "a"), (5, long, "en", None), (6, long, "en", "a"),
        (7, "x" * 100_000, None, "c"), (8, "the same text of a few words here", "en", "c"), (8, "the same text of a few words here", "en", "c"),
        (9, "the same text of a few words here", "de", ""), (None, "no id but a text of the usual kind", None, None),
    ]
