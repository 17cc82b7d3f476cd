"""The queries over all of ADJ, against plain Python over every line."""

from itertools import pairwise

import pytest

from tests.conftest import SF
from tidegraph import queries


@pytest.fixture(scope="module")
def adj(duck):
    """Edges by hand: each line's part to the next line's in its order, whatever the quantities."""
    lines = duck.execute("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem ORDER BY 1, 2, 3").fetchall()
    return {(str(a[2]), str(b[2])) for a, b in pairwise(lines) if a[0] == b[0] and a[2] != b[2]}


def test_importers_of_all_lines(spark, adj):
    want = {d: sorted(s for s, x in adj if x == d) for d in {d for _, d in adj}}
    got = {r.dst: r for r in queries.QUERIES["importers_index_all"](spark, SF).collect()}
    assert {d: r.importers.split(",") for d, r in got.items()} == want
    assert sum(r.n_importers for r in got.values()) == len(adj)


def test_edge_filter_over_all_lines(spark, duck, adj):
    own = {str(k) for (k,) in duck.execute("SELECT p_partkey FROM part WHERE p_size <= 25").fetchall()}
    got = [tuple(r) for r in queries.QUERIES["external_edge_filter_all"](spark, SF).select("src", "dst").collect()]
    assert sorted(got) == sorted((s, d) for s, d in adj if s in own and d in own)


def closed(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    into = {}
    for s, d in edges:
        into.setdefault(d, []).append(s)
    while todo:
        for s in into.get(todo.pop(), []):
            if s not in seen:
                seen.add(s)
                todo.append(s)
    return seen


def test_closure_over_all_lines(spark, duck, adj):
    seeds = {str(k) for (k,) in duck.execute("SELECT l_partkey FROM lineitem WHERE l_shipdate = (SELECT max(l_shipdate) FROM lineitem)").fetchall()}
    got = [r.node_id for r in queries.QUERIES["impact_adj_closure_all"](spark, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == closed(adj, seeds)


def test_closure_of_a_small_cyclic_table(spark, tmp_path):
    """Paths lead through lines of any quantity; what only follows a seed isn't reached."""
    lines = [(1, 1, 10, 1.0, "2000-01-01"), (1, 2, 20, 50.0, "2000-01-02"), (2, 1, 20, 2.0, "2000-01-03"), (2, 2, 30, 3.0, "2000-01-09"), (2, 3, 40, 50.0, "2000-01-04")]
    lines += [(3, 1, 30, 44.0, "2000-01-05"), (3, 2, 10, 1.0, "2000-01-06"), (4, 1, 50, 50.0, "2000-01-07"), (4, 2, 50, 50.0, "2000-01-08")]
    df = spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, day string").selectExpr("*", "cast(day AS timestamp) l_shipdate")
    df.write.parquet(f"{tmp_path}/lineitem.parquet")
    assert sorted(r.node_id for r in queries.QUERIES["impact_adj_closure_all"](spark, str(tmp_path)).collect()) == ["10", "20", "30"]
