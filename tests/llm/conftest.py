import pytest

ODD = [
    (0, "The quick brown fox jumps over the lazy dog " * 9),
    (1, "The quick brown fox jumps over the lazy dog " * 9),
    (2, None),
    (3, ""),
    (4, "   \n\t "),
    (5, "one"),
    (6, "Ünïcode wörds, Released under the MIT License. And more"),
    (7, "x " * 30000),
    (None, "a row without an id that says the quick brown fox jumps over the lazy dog once more and more"),
    (8, "repeated row"),
    (8, "repeated row"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and columns that operators might use themselves."""
    rows = [(i, t, "en", "s", 1, 2.0, "k", 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score double, kept_text string, n_words int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.filter("doc_id = -1")
