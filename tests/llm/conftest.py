import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, an extra column with a clashing name."""
    long = " ".join(f"w{i % 977}" for i in range(30_000))
    rows = [
        (1, "The cat sat on the mat. It's 42 <|endoftext|> café\n\nend", "en", "a", 1),
        (2, None, "en", "a", 2),
        (3, "", None, None, 3),
        (4, " \t\n\x0b\x0c\r ", "en", "b", None),
        (5, long, "en", "b", 5),
        (6, "same text here\nsame text here\nsame text here", "de", "a", 6),
        (6, "same text here\nsame text here\nsame text here", "de", "a", 6),
        (6, "another text of the same id", "de", "a", 6),
        (None, "no id at all but words", "fr", "c", 7),
        (7, "日本語   \U0001f600\U0001f600 � á \x1cx", "ja", "c", 8),
        (8, "x" * 5000, "en", "c", 9),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").withColumn("score", F.lit("clash"))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def small():
    return "/root/testdata/sf0.001"
