import pytest

from cohortry.llm.common import T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType()), T.StructField("key", T.StringType()), T.StructField("label", T.StringType())])

#: Long enough to be cut into chunks, slices and windows.
LONG = " ".join(f"word{i % 977} of{i % 31}" for i in range(60_000))


@pytest.fixture(scope="session")
def docs(spark):
    """Null ids and texts, empty and very long texts, ties, repeated rows, columns with clashing names."""
    rows = [(1, "Alpha beta gamma delta epsilon zeta.\nSecond line here with words enough."), (2, None), (3, ""), (None, "no id at all, but some words 10.0.0.1"), (5, LONG), (5, LONG),
            (6, "   \n\n  "), (7, "Alpha beta gamma delta epsilon zeta.\nSecond line here with words enough."), (8, "ÄÖÜ ñandú 漢字 𝒳   　 mixed\ttext\x0bhere"), (8, "another text, same id"),
            (9, "x" * 30_000), (None, None), (10, "<|endoftext|> inside <|endoftext|>  text")]
    return spark.createDataFrame([(i, t, None if i == 2 else "en", "src", None if t is None else len(t), "k", "l") for i, t in rows], DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def sample(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")
