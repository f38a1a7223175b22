import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """documents from texts; ids count up."""

    def build(texts, first=0, sources=None, langs=None):
        rows = [(first + i, t, (langs or ["en"] * len(texts))[i], (sources or ["s"] * len(texts))[i], len(t or "")) for i, t in enumerate(texts)]
        return spark.createDataFrame(rows, SCHEMA)

    return build


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, extra columns with clashing names."""
    long = " ".join(f"word{i % 997} and{i}" for i in range(30_000))
    rows = [(1, None, None, None), (2, "", "en", ""), (3, " \n\t ", "en", "a"), (4, "one", "en", "a"), (4, "one", "en", "a"), (5, long, "fr", "b"), (6, long, "fr", None), (7, "¡! 123 €", None, "b"), (None, "one two three", "en", "a"), (8, "Ünïcödé 漢字 😀\nline\r\nx", "de", "c")]
    wide = [(*r, i, "x", 1.0, "y", True, 7) for i, r in enumerate(rows)]
    return spark.createDataFrame(wide, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, component string, kept boolean, n long")
