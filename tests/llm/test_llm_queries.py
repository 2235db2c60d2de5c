import pytest

from cartolith.llm import catalog


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(name, same_as_sql):
    same_as_sql(catalog.QUERIES[name], catalog.SQL[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs(name, spark, data_dir):
    assert catalog.QUERIES[name](spark, data_dir).count() >= 0
