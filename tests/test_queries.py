import pytest

from tests.conftest import SF, oracle_rows, rows
from tidegraph import queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_against_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    assert rows(df) == oracle_rows(duck, queries.SQL[name])


def test_flagship(spark):
    r = queries.flagship(spark, SF).collect()
    assert r and {x.marker for x in r} <= {"*", "~", " "}
