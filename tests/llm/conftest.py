import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """A small table from rows and a DDL schema, over three partitions."""

    def make(rows, schema):
        return spark.createDataFrame(rows, schema).repartition(3)

    return make
