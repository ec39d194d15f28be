"""Every registered query with SQL agrees with DuckDB on the smallest tables; the driver contract holds."""

import pytest
from oracle import compare, connect

import __spark_entry__ as contract
from conftest import SMALL
from panelspark.plans.catalog import QUERIES

CHECKED = [n for n, q in QUERIES.items() if q.oracle is not None]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    assert compare(spark, con, SMALL, name) in (None, "EMPTY")


def test_contract(spark):
    assert contract.entry(spark).count() > 0
    assert set(contract.oracle_sql()) - set(contract.MORE_SQL) == set(CHECKED) <= set(contract.queries())
    assert set(contract.MORE_SQL) <= set(contract.MORE)
    assert all(callable(f) for f in contract.queries().values())
