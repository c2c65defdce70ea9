"""Tables of the cases that every operator must take."""

import pytest


@pytest.fixture(scope="session")
def frame(spark):
    """Rows to a DataFrame of several partitions; a type string names the columns."""

    def make(rows, types, partitions=3):
        return spark.createDataFrame([tuple(r) for r in rows], types).repartition(partitions)

    return make
