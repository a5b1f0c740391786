"""Queries of the training-data operators against SQL, on whole tables."""

import pytest

from loamstone.llm import queries as q
from tests.helpers import same_rows

QUERIES, SQL = q.queries(), q.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, data, duck):
    same_rows(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0
