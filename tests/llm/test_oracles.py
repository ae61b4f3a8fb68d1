"""Corpus queries beside their SQL."""

import pytest

from compare import compare, duck_of
from trendloom.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf_dir, name):
    assert compare(spark, duck_of(sf_dir), queries.QUERIES[name], queries.ORACLE_SQL[name], sf_dir) == ""
