"""Every query with equivalent SQL gives its rows."""

import pytest

from cartolith.plans import catalog, catalog_sql, problems, problems_sql

QUERIES = {**catalog.QUERIES, **problems.QUERIES}
SQL = {**catalog_sql.SQL, **problems_sql.SQL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(name, same_as_sql):
    same_as_sql(QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(name, spark, data_dir):
    assert QUERIES[name](spark, data_dir).count() >= 0


def test_sql_has_queries():
    assert set(SQL) <= set(QUERIES)
