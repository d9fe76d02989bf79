"""Every registered query against its SQL, and the driver's contract."""

import pytest

from terralyn.plans import registry


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(name, same):
    same(registry.QUERIES[name], registry.ORACLE_SQL[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_without_sql_runs(name, spark, sf):
    assert registry.QUERIES[name](spark, sf).limit(5).collect() is not None


def test_entry_has_rows(spark, monkeypatch):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
