import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("node", T.StringType()), T.StructField("score", T.DoubleType())])

LONG = " ".join(f"word{i * i * 7919 % 99991 + i}" for i in range(30_000))
PASSAGE = " ".join(f"passage{i}" for i in range(60))


@pytest.fixture(scope="session")
def docs(spark):
    """Nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs away from the hunters of the old forest"
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (5, "   \n\t "), (6, LONG), (None, base), (7, base + " today"), (8, "one two"), (9, "one two"), (10, "é" * 300 + PASSAGE), (11, "ü" * 300 + PASSAGE + " end"), (12, "a" * 500), (13, "<|endoftext|> <s> </s> ▁▁ \U0001f600"), (14, "Released under the MIT License.\nAll rights reserved.")]
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t), "x", None) for i, t in texts], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def corpus(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
