"""Every query against its SQL twin on the smallest tables."""

import os

import pytest

from tests.compare import connect, difference, duck_rows, spark_rows
from watchtide.catalog import ORACLES, QUERIES

SF_DIR = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    left = spark_rows(QUERIES[name](spark, SF_DIR))
    if name not in ORACLES:
        assert left[1]
        return
    assert difference(left, duck_rows(con, ORACLES[name])) is None
