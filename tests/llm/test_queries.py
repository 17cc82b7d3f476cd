import pytest

from tests.conftest import SF, oracle_rows, rows
from tidegraph.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_against_sql(spark, duck, name):
    assert rows(queries.QUERIES[name](spark, SF)) == oracle_rows(duck, queries.SQL[name])


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES} == set(range(1, 11))
