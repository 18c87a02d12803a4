"""Every registered query against its SQL in DuckDB."""

import os

import pytest
from compare import connect, differences, oracle_rows, spark_rows

from thrustlog import registry

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
QUERIES, ORACLE = registry.queries(), registry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = spark_rows(QUERIES[name](spark, SF_DIR))
    assert got[1]
    if name in ORACLE:
        assert not differences(got, oracle_rows(duck, ORACLE[name]))


def test_oracles_belong_to_queries():
    assert set(ORACLE) <= set(QUERIES)
