"""Every registered query against its check statement, and the driver contract."""

import pytest

import __spark_entry__ as contract
from compare import connect, difference
from tidewatch.plans import CHECKS, QUERIES


@pytest.fixture(scope="module")
def con(folder):
    return connect(folder)


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query(spark, folder, con, name):
    assert difference(spark, con, folder, QUERIES[name], CHECKS[name]) is None


def test_contract(spark):
    assert contract.queries().keys() >= contract.oracle_sql().keys()
    first = contract.entry(spark)
    assert first.schema == contract.entry(spark).schema and first.count() > 0


def test_every_query_has_a_check():
    assert set(QUERIES) == set(CHECKS)
