import pytest
from pyspark.sql import types as T

#: Names that operators use inside, as extra columns of the input.
CLASHING = ["n", "h1", "h2", "key", "block", "node", "row", "root", "score", "copies", "weight", "place", "halo", "start", "ids", "sha", "size", "s", "p", "o", "w"]
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in CLASHING]
)
LONG = " ".join(f"word{i % 997} and{i}" for i in range(20_000))
EDGE = [
    (1, "one two three four five six seven", "en", "a"), (2, "one two three four five six seven", "en", "a"), (2, "one two three four five six seven", "en", "a"),
    (3, "", None, None), (4, None, "en", "b"), (5, "   \n\t ", "de", "b"), (None, "lost in the middle of the night without a number", "en", None),
    (None, None, None, None), (7, LONG, "en", "a"), (8, LONG + " end", "en", "a"), (9, "x", "", ""), (10, "12 345 !! ??", "en", "c"),
    (11, "  two  blanks  and ▁ markers ▁▁ ", "fr", "c"), (12, "Größe über ÉTÉ niño 日本語 ﬁ①\x00 end", "de", "c"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty and long texts, ties, repeated rows and extra columns."""
    rows = [(d, t, lang, src, None if t is None else len(t), *["7"] * len(CLASHING)) for d, t, lang, src in EDGE]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="session")
def none(spark):
    """The same columns without rows."""
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").cache()
