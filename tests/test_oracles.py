"""Every named query agrees with its SQL; those without SQL give rows."""

import pytest
from oracle import connect, difference

import __spark_entry__ as driver

QUERIES, ORACLES = driver.queries(), driver.oracle_sql()


@pytest.fixture(scope="module")
def con(data):
    return connect(data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, data, name):
    if name in ORACLES:
        assert difference(spark, con, QUERIES[name], ORACLES[name], data) == ""
    else:
        assert QUERIES[name](spark, data).count() > 0


def test_entry(spark):
    assert driver.entry(spark).count() > 0
