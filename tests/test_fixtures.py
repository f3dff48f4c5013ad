"""Operators on small stated documents, files and stub models, whose rows were worked out by hand."""

import file_queries  # adds its cases
import fixture_queries
import pytest

assert file_queries.golden is fixture_queries.golden


@pytest.mark.parametrize("name", sorted(fixture_queries.QUERIES))
def test_stated_rows(name, agree):
    agree(fixture_queries.QUERIES[name], fixture_queries.ORACLES[name])
