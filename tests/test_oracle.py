"""Every core query that SQL can express gives DuckDB's rows; the others run and have rows."""

import pytest

from loamstone.plans import catalog
from tests.helpers import same_rows

QUERIES, SQL = catalog.queries(), catalog.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(name, spark, data, duck):
    same_rows(QUERIES[name](spark, data), duck, SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data):
    assert QUERIES[name](spark, data).count() > 0


def test_registered_core_queries_need_no_training_data_package():
    assert not any(q.__module__.startswith("loamstone.llm") for q in QUERIES.values())


def test_chunks_of_96_cover_whole_texts(spark, data):
    longest = QUERIES["chunks_96"](spark, data).groupBy("doc_id").count().agg({"count": "max"}).first()[0]
    assert longest > 1 and QUERIES["chunks_96"](spark, data).filter("chunk_idx = 0").count() == QUERIES["one_chunk_documents"](spark, data).count()
