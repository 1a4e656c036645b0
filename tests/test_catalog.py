"""The driver contract, and every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from catalog import QUERIES
from compare import connect, differences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_contract(spark):
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) >= 55
    assert contract.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    oracles = contract.oracle_sql()
    if name in oracles:
        assert differences(spark, con, contract.queries()[name], oracles[name], SF) == []
    else:
        assert contract.queries()[name](spark, SF).count() > 0
