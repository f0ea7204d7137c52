import pytest


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) of sf0.01 as Python rows."""
    return [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]


#: Nulls, empty and long texts, ties, repeated rows, and extra columns with names that the operators use.
EDGES = [
    (1, None, 0, "a"), (2, "", 0, "a"), (3, " \n\t ", 1, None), (4, "one", 1, "b"), (5, "one", 1, "b"), (5, "one", 1, "b"), (None, "a b c d e f g h i j k", 2, "c"),
    (7, "x" * 300_000, 3, "d"), (8, "word " * 30_000, 3, "d"), (9, "é ü ñ — “q” 日本語 \u2003 \x1c z" * 40, 4, "e"), (10, " ".join(f"w{k}" for k in range(60_000)), 4, "e"),
]
EDGE_SCHEMA = "doc_id bigint, text string, fp bigint, stats string"


@pytest.fixture(scope="session")
def edges(spark):
    return spark.createDataFrame(EDGES, EDGE_SCHEMA)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], EDGE_SCHEMA)
