import pytest

ODD = [
    (1, "Same Text", "en"), (2, "same text", None), (3, None, "x"), (4, "", None), (None, "same TEXT", "y"), (None, None, None),
    (5, "ÄSAME text", "d"), (6, "äsame text", "d"), (7, "x " * 30000, "d"), (7, "x " * 30000, "d"),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, and a column whose name an operator might use itself."""
    return spark.createDataFrame([(*r, "clash", 1) for r in ODD], "doc_id long, text string, lang string, _text string, _id long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
