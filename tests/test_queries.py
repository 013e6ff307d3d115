"""Every registered query against DuckDB."""

import pytest

from checks.compare import connect, difference
from checks.oracle import ORACLE
from checks.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, duck, name):
    if name not in ORACLE:
        pytest.skip("no SQL for a random draw")
    assert difference(spark, duck, SF, name) is None


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).count() == 70
    assert set(driver.oracle_sql()) <= set(driver.queries())
