"""Every registered query of the warehouse against DuckDB on the same tables."""

import pytest

import __spark_entry__ as driver
from compare import connect, differences
from conftest import SF_DIR
from tidewharf.catalogue import QUERIES


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(driver.oracle_sql())
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_entry(spark):
    result = driver.entry(spark)
    assert result.columns == ["order_year", "p_brand", "revenue"]
    assert result.count() == 10


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    result = driver.queries()[name](spark, SF_DIR)
    assert differences(duck, result, driver.oracle_sql()[name]) == []
