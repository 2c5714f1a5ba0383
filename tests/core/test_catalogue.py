import pytest

from gridlore.plans import catalogue, observation_queries, registry, run_queries, search_queries, source_queries, space_queries  # noqa: F401  all register queries

from ..compare import differences


@pytest.mark.parametrize("name", list(registry.ORACLE_SQL))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(spark, sf_dir, registry.QUERIES[name], registry.ORACLE_SQL[name]) is None


@pytest.mark.parametrize("name", [n for n in registry.QUERIES if n not in registry.ORACLE_SQL])
def test_query_runs(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0
