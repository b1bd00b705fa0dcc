import pytest
from pyspark.sql import types as T

DOC = T.StructType([T.StructField(n, t) for n, t in (("doc_id", T.LongType()), ("text", T.StringType()), ("lang", T.StringType()), ("source", T.StringType()), ("n_chars", T.LongType()))])


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (doc_id, text) pairs, with the other columns of the table."""

    def build(rows, partitions=3):
        full = [(i, t, "en", "s", None if t is None else len(t)) for i, t in rows]
        return spark.createDataFrame(full, DOC).repartition(partitions)

    return build


@pytest.fixture(scope="session")
def table_dir(spark, make, tmp_path_factory):
    """A folder with a documents table of the given rows."""

    def build(rows):
        path = tmp_path_factory.mktemp("sf")
        make(rows).write.parquet(f"{path}/documents.parquet")
        return str(path)

    return build


EDGES = [(None, "null id text"), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "same words here again"), (5, "same words here again"), (6, "same words here again"), (7, "a " * 3000)]


@pytest.fixture(scope="session")
def edges():
    """Null ids and texts, empty and blank texts, repeated rows and ids, a long text."""
    return EDGES
