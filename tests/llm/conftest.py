import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept int"


@pytest.fixture
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows and clashing extra columns."""
    rows = [
        (1, "the and of to that with this they have from " * 12, "en", "a", 3, "x", 1),
        (1, "the and of to that with this they have from " * 12, "en", "a", 3, "x", 1),
        (2, None, "en", None, None, None, None),
        (3, "", None, "b", 0, None, None),
        (None, "der die und das nicht ist mit den von sich " * 9, "de", "a", 1, "y", 0),
        (4, " \n\t ", "de", "a", 3, None, None),
        (5, "le la les des une est pas pour que dans " * 4000, "fr", "b", 9, "z", 1),
        (6, "1234 %% ###", "fr", None, 9, "z", 1),
        (7, "word\nword\nword\nother line here\n\nword ", "en", "c", 9, None, 1),
    ]
    return spark.createDataFrame(rows, SCHEMA)
