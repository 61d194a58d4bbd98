"""Every named query on the smallest data against its SQL."""

import os

import pytest

import __spark_entry__ as contract
from check import compare, connect

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data not present")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


def test_flagship_runs(spark):
    df = contract.entry(spark)
    assert df.columns and df.count() > 0


@pytest.mark.parametrize("name", sorted(contract.queries()))
def test_query_equals_sql(spark, con, name):
    rows = contract.queries()[name](spark, FOLDER).toPandas()
    sql = contract.oracle_sql().get(name)
    assert sql is None or compare(rows, con.execute(sql).df()) == "ok"
