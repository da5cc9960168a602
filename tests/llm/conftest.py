import pytest

LONG = "lorem ipsum dolor sit amet " * 4000

#: Null, empty and blank texts, null and repeated ids, ties, a very long text.
ROWS = [(1, None), (2, ""), (3, " \t\n"), (None, "hello big world"), (4, "hello big world"), (4, "hello big world"), (5, LONG), (6, "x" * 30_000), (7, "a\n\nb"), (8, "Hello  big\tworld"), (9, "!!! 123")]


@pytest.fixture(scope="session")
def edge(spark):
    """Odd rows, with further columns whose names clash with ones that operators use."""
    names = "doc_id long, text string, id string, row int, lid int, fp string, component string, key string, score string, h int, n string, first int, spans string, lang string"
    rows = [(i, t, "x", 1, 2, "f", "c", "k", "s", 3, "n", 4, "sp", "en") for i, t in ROWS]
    return spark.createDataFrame(rows, names).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(edge):
    return edge.limit(0)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


@pytest.fixture(scope="session")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}
