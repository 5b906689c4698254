from __future__ import annotations

import pytest

from tests.llm.cases import SCHEMA, awkward


@pytest.fixture(scope="session")
def rows_in():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows_in):
    return spark.createDataFrame(rows_in, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
