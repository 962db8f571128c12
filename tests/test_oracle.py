"""Every registered query against its oracle SQL, on whole tables."""

import __spark_entry__ as contract
import pytest
from blockloom.plans import catalog
from oracle_check import compare, connect

NAMES = sorted(catalog.queries())


@pytest.fixture(scope="module")
def con(sf):
    return connect(sf)


def test_every_query_has_an_oracle():
    assert set(NAMES) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, con, sf, name):
    ok, message, _, _ = compare(spark, con, contract.queries()[name], contract.oracle_sql()[name], sf)
    assert ok, message


def test_entry(spark, sf):
    df = contract.entry(spark)
    assert df.columns == ["split", "shard", "batch", "blk", "ids", "special"]
    assert df.count() > 0
