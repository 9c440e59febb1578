import pytest

from quire.llm import queries


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_is_its_sql(same_as_sql, name):
    assert same_as_sql(queries.queries()[name], queries.oracle_sql()[name]) > 0
