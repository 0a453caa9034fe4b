"""Every named query against its reference SQL, on the smallest supplied tables."""

import os

import pytest
from oracle import compare, connect

import __spark_entry__ as entry
from evidence_lake.plans import catalog

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not supplied")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, con, name):
    sql = entry.oracle_sql()
    assert name in sql
    problem = compare(spark, con, FOLDER, entry.queries()[name], sql[name])
    assert problem is None, problem


def test_entry(spark):
    assert entry.entry(spark).count() > 0
