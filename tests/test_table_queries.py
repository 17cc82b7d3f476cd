import pytest

from tests.conftest import SF, oracle_rows, rows
from tidegraph import table_queries


@pytest.mark.parametrize("name", sorted(table_queries.SQL))
def test_query_against_sql(spark, duck, name):
    got = rows(table_queries.QUERIES[name](spark, SF))
    assert got and got == oracle_rows(duck, table_queries.SQL[name])
