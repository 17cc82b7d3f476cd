import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tidegraph.operators.closure import reverse_closure


def brute(edges, seeds):
    seen, todo = set(seeds), list(seeds)
    while todo:
        at = todo.pop()
        for s, d in edges:
            if d == at and s not in seen:
                seen.add(s)
                todo.append(s)
    return seen


def run(spark, edges, seeds):
    e = spark.createDataFrame(edges, "src string, dst string")
    s = spark.createDataFrame([(x,) for x in seeds], "node_id string")
    return [r.node_id for r in reverse_closure(e, s).collect()]


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("abcdefgh")), max_size=20), st.sets(st.sampled_from("abcdefghz"), max_size=3))
def test_random_graphs(spark, edges, seeds):
    got = run(spark, edges, sorted(seeds))
    assert len(got) == len(set(got))
    assert set(got) == brute(edges, seeds)


def test_cycles_self_edges_and_nulls(spark):
    edges = [("a", "b"), ("b", "a"), ("c", "c"), ("d", "a"), (None, "a"), ("e", None), ("a", "b")]
    assert sorted(run(spark, edges, ["b"])) == ["a", "b", "d"]
    assert run(spark, edges, []) == []
    assert run(spark, [], ["q"]) == ["q"]


def test_deep_chain_cuts_parts_together(spark):
    edges = [(f"n{i + 1}", f"n{i}") for i in range(20)]
    assert len(run(spark, edges, ["n0"])) == 21


def test_keys_stay_apart(spark):
    e = spark.createDataFrame([("p", "a", "b"), ("q", "c", "b")], "project string, src string, dst string")
    s = spark.createDataFrame([("p", "one", "b"), ("p", "two", "a"), ("q", "one", "b")], "project string, change_set_id string, node_id string")
    got = sorted(tuple(r) for r in reverse_closure(e, s, ["project"], ["change_set_id"]).select("project", "change_set_id", "node_id").collect())
    assert got == [("p", "one", "a"), ("p", "one", "b"), ("p", "two", "a"), ("q", "one", "b"), ("q", "one", "c")]


def test_large_frontiers_join_by_shuffle(spark, monkeypatch):
    from tidegraph import work

    monkeypatch.setattr(work, "small", lambda df, rows, limit=0: df)
    r = random.Random(5)
    edges = [(str(r.randrange(60)), str(r.randrange(60))) for _ in range(90)]
    assert set(run(spark, edges, ["1", "2"])) == brute(edges, {"1", "2"})


def test_round_limit(spark):
    e = spark.createDataFrame([("b", "a"), ("c", "b")], "src string, dst string")
    with pytest.raises(RuntimeError):
        reverse_closure(e, spark.createDataFrame([("a",)], "node_id string"), max_rounds=1)
