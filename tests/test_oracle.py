"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as contract
from catalog import ORACLE, QUERIES
from check import compare, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(contract.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = contract.queries()[name](spark, SF)
    assert compare(df, duck.execute(ORACLE[name])) is None


def test_entry(spark):
    assert contract.entry(spark).count() > 0
