import pytest
from pyspark.sql import types as T

DOCUMENT_FIELDS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Makes a documents table of (doc_id, text, source) rows."""

    def make(rows):
        return spark.createDataFrame(
            [(i, text, "en", source, None if text is None else len(text)) for i, text, source in rows], DOCUMENT_FIELDS
        ).repartition(3)

    return make


@pytest.fixture(scope="session")
def odd_documents(documents):
    """Null and empty texts, null ids and sources, repeated rows, ties, long texts, odd white space."""
    long = " ".join(f"word{i % 977} other{i % 13}" for i in range(30_000))
    rows = [
        (1, "The quick brown fox jumps over the lazy dog again and again.", "a"),
        (1, "The quick brown fox jumps over the lazy dog again and again.", "a"),
        (2, None, "a"),
        (3, "", "b"),
        (4, "  \t\n\x0b\x0c\r ", None),
        (None, "A text without an id but with some words in it.", None),
        (None, None, None),
        (5, long, "b"),
        (6, "the quick brown fox jumps over the lazy dog again and again.", "a"),
        (2**60 + 1, "Große Überraschung: 漢字 é é \U0001f600 don't <|endoftext|>", ""),
        (7, "one", "\U0001f600"),
        (7, "two three\x85four five", "￿"),
    ]
    return documents(rows)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents([])


@pytest.fixture
def clashing(request):
    """Adds columns whose names the operators use themselves."""

    def add(df):
        from pyspark.sql import functions as F

        for name in ("_text", "_key", "score", "size", "fp", "label", "draws", "target", "taken", "text_", "_row", "n"):
            df = df.withColumn(name, F.lit("clash"))
        return df

    return add


LABEL_SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("quality", T.IntegerType()), T.StructField("toxic", T.IntegerType())]
)
