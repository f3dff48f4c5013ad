"""Every registered query against its SQL."""

import pytest

import __spark_entry__ as driver
from lectern.plans import registry


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query_matches_sql(name, agree):
    agree(registry.QUERIES[name], registry.ORACLES[name])


def test_every_query_has_sql():
    assert set(registry.QUERIES) == set(registry.ORACLES)


def test_entry(spark):
    assert driver.entry(spark).count() == 1
    assert set(registry.QUERIES) <= set(driver.queries())
