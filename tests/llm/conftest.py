import pytest
from llm_helpers import DOCS, EDGE


@pytest.fixture(scope="session")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def clashing(edge):
    """The edge rows with further columns named as the operators name theirs."""
    from pyspark.sql import functions as F

    names = "key row size line pos h h1 h2 taken target start length sequence_id offset kept score low rank n_words base".split()
    return edge.select("*", *[F.lit("x").alias(n) for n in names])
