import pytest
from pyspark.sql import functions as F

LONG = "lorem ipsum dolor sit amet " * 4000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and long texts, ties, repeated rows, and extra columns with names the operators use."""
    words = " ".join(f"word{i}" for i in range(60))
    rows = [
        (1, words, "en", "a"), (2, words, "en", "a"), (2, words, "en", "a"), (3, words + " more", "en", None),
        (4, None, "en", "b"), (5, "", None, "b"), (6, " \t\n\x0b\f\r ", "de", "b"), (7, "x", "de", "c"),
        (8, "Ünïcödé 漢字 😀 text", "zz", "c"), (None, "a row without an id", None, "c"), (None, None, None, None),
        (9, LONG, "en", "a"), (10, LONG + "end", "en", "a"), (11, "b" * 70_000, "en", "c"),
        (2, "another text of the same id", "en", "a"), (12, "\n".join([words, "short", words, ""]), "en", "a"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for name in ("n_chars", "block", "size", "line", "bucket", "row", "rank", "n", "target", "component", "_id", "ids"):
        docs = docs.withColumn(name, F.lit(7).cast("long"))
    return docs


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")


@pytest.fixture(scope="session")
def sf(spark):
    import os

    return os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def documents(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
