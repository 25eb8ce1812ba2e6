import pytest

EDGES = [
    (None, "no id at all, only these few words stand here"),
    (1, None),
    (2, ""),
    (3, "   \n\t "),
    (4, "one"),
    (5, "tie tie tie tie tie tie tie"),
    (6, "the same row twice " * 30),
    (6, "the same row twice " * 30),
    (7, "café ñandú ÉCLAIR 💥 " * 40),
    (8, "word" * 30_000),
    (9, " ".join(f"w{i % 977}" for i in range(20_000))),
]


@pytest.fixture(scope="session")
def edges(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names clash with those of operators."""
    return spark.createDataFrame(
        [(i, t, 1, 2, 3, "x") for i, t in EDGES], "doc_id long, text string, node long, seed long, length long, component string"
    ).repartition(3)


@pytest.fixture(scope="session")
def empty(edges):
    return edges.filter("false")


@pytest.fixture(scope="session")
def sample():
    import pyarrow.parquet as pq

    return pq.read_table("/root/testdata/sf0.01/documents.parquet").to_pandas().set_index("doc_id").text
