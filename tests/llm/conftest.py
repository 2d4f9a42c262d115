import pytest

#: Cases that every operator meets: nulls, empty and very long texts, ties and repeated rows, a clashing column.
ODD = [(None, "null id", "x"), (1, None, "x"), (2, "", None), (3, "   \n\t ", "x"), (4, "same text here", "x"), (5, "same text here", "y"), (5, "same text here", "y"), (6, "Very long. " * 20_000, "x"), (7, "!!! ???", "x"), (8, "İ ﬁ क़. <|endoftext|>  a\x1cb", "x")]


@pytest.fixture(scope="session", autouse=True)
def small_batches(spark):
    """Small tables come in many batches here, as large ones do in production."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "64k")


@pytest.fixture(scope="session")
def odd(spark):
    """Odd rows, with columns whose names the operators use themselves."""
    from pyspark.sql import functions as F

    return spark.createDataFrame(ODD, "doc_id long, text string, uid string").withColumns({"block": F.lit(1), "score": F.lit("s"), "_part": F.lit(2)})


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
