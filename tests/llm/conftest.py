import pytest


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Documents with nulls everywhere, empty and very long texts, repeated rows, and columns of clashing names."""
    long_text = " ".join(f"word{i % 997} and{i % 31}" for i in range(60_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today and then it runs home again quickly", "en", "a"),
        (1, "The quick brown fox jumps over the lazy dog near the river bank today and then it runs home again quickly", "en", "a"),
        (2, None, "en", None),
        (3, "", None, "b"),
        (4, "   \n\t ", None, "b"),
        (None, "no id here", None, None),
        (None, None, None, None),
        (5, long_text, "en", "c"),
        (6, long_text + " end", "en", "c"),
        (7, "Ünïcödé 漢字 😀 \x00 text", "de", "c"),
        (8, "1234 5678 !!! ???", None, "c"),
    ]
    cols = ["doc_id", "text", "lang", "source", "id", "chunk", "y", "score", "length", "place"]
    data = [(*r, i, "x", None, 0.5, -1, None) for i, r in enumerate(rows)]
    kinds = "long, text string, lang string, source string, id int, chunk string, y string, score double, length int, place string"
    return spark.createDataFrame(data, "doc_id " + kinds).select(*cols)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.where("false")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
