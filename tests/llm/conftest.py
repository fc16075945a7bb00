import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Texts with nulls, blanks, repeats, one very long text and a column whose name an operator may use itself."""

    def make(rows):
        return spark.createDataFrame(
            [(i, t, lang, source, len(t or ""), "x") for i, t, lang, source in rows], DOCS + ", line string"
        )

    return make


@pytest.fixture(scope="session")
def odd_rows():
    long = "word " * 40_000
    return [
        (1, None, "en", "a"), (2, "", "en", "a"), (3, "  \n\t ", None, None), (4, "12 34 !!", "en", "b"), (5, "one", "en", "b"),
        (6, long, "en", "b"), (7, "same text here\nand a second line of it", "en", "c"), (7, "same text here\nand a second line of it", "en", "c"),
        (8, "same text here\nand a second line of it", "en", None), (None, "no id has this text", "en", "c"), (None, None, None, None),
    ]
