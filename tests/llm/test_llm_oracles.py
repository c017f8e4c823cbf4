"""The queries with a SQL restatement against it."""

import compare
import pytest

from gradeline.llm import queries


@pytest.fixture(scope="module")
def con(sf_dir):
    return compare.connect(sf_dir)


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_query_equals_sql(name, spark, sf_dir, con):
    assert compare.differences(queries.QUERIES[name](spark, sf_dir), con, queries.ORACLE_SQL[name]) == []
