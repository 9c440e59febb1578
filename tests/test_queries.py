"""Every registered query of the engine's own operators: against its SQL, or for its rows."""

import pytest

from quire.plans import registry

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_is_its_sql(same_as_sql, name):
    assert same_as_sql(registry.queries()[name], SQL[name]) > 0


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_query_without_sql_gives_rows(spark, small, name):
    assert registry.queries()[name](spark, small).count() > 0
