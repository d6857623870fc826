import pytest

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "mot " * 60_000


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls everywhere, empty and very long texts, repeated rows and ids, and a column with a clashing name."""
    rows = [
        (1, "the house is on the hill and the river runs by it every day of the year\nsame line", "en", "a", 1),
        (1, "the house is on the hill and the river runs by it every day of the year\nsame line", "en", "a", 1),
        (2, None, "en", "a", None),
        (3, "", None, None, 0),
        (4, "  \n\t ", "de", "b", 0),
        (None, "the house is on the hill", None, "b", 3),
        (5, LONG, "fr", "b", len(LONG)),
        (6, "x", "xx", "", 1),
        (7, "same line\nsame line\n\nother words here", "en", None, 1),
        (7, "another text with the same id but different words in it", "en", None, 1),
        (8, "Grüße \U0001f600 </s> <|endoftext|> café naïve it's", "de", "c", 1),
    ]
    from pyspark.sql import functions as F

    return spark.createDataFrame(rows, SCHEMA).withColumns({"id": F.lit("clash"), "key": F.lit(0), "size": F.lit("clash"), "kept": F.lit("clash")})


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
