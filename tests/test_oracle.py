"""Every registered query against its SQL on sf0.01."""

import pytest

import __spark_entry__ as driver
from quayside.catalogue import ORACLES, QUERIES
from tools.compare import compare, database

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_agrees(spark, con, name):
    assert compare(spark, con, FOLDER, name) is None


def test_driver_contract(spark):
    rows = driver.entry(spark).collect()
    assert rows and [r.zone_pos for r in rows] == sorted(r.zone_pos for r in rows)
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert set(ORACLES) <= set(driver.oracle_sql())
