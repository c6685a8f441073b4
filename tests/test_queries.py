"""Every registered query against its checking statement at the smallest scale."""

import pytest

import __spark_entry__ as entry
from testbed import registered
from testbed.compare import compare, connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# The queries of an optional subpackage are tested beside it.
OWN = sorted(registered())


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, con, name):
    verdict, rows = compare(spark, con, SF, QUERIES[name], ORACLES.get(name))
    assert verdict == ("ok" if name in ORACLES else "rows only") and rows >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
