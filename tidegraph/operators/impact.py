"""Impact of change sets on test targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import work
from .classify import classify, gate
from .closure import reverse_closure
from .graph import Graph

SET = ["project", "change_set_id"]


def uncertain_closure(graph: Graph) -> DataFrame:
    """``(project, node_id)``: what depends on an import that can't be resolved. It doesn't depend on changes: take it once a graph and pass it on."""
    seeds = graph.nodes.where("has_dynamic").select("project", "node_id")
    return reverse_closure(graph.edges, seeds, ["project"])


def test_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.where("has_tests").select("project", "node_id").distinct()


def impact_rows(graph: Graph, changes: DataFrame, change_sets: DataFrame | None = None, uncertain: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The result as rows, for change sets of any size: gates (see ``gate``) and ``(project, change_set_id, node_id, kind)``.

    Kinds: ``changed`` for each changed node, ``target`` for each test node to run, ``uncertain`` for a target only there for an unresolved
    import. A full run has all test nodes as targets and nothing else. ``change_sets`` names sets that may have no change at all.
    """
    classed = work.checkpoint(classify(changes, graph.node_files, graph.analyzer))
    sets = classed.select(*SET) if change_sets is None else classed.select(*SET).unionByName(change_sets.select(*SET))
    gates = sets.distinct().join(gate(classed), SET, "left")
    gates = gates.select(*SET, F.coalesce("full_run", F.lit(False)).alias("full_run"), F.coalesce("full_run_reasons", F.array().cast("array<string>")).alias("full_run_reasons"))
    gates = work.checkpoint(gates)
    narrow, full = gates.where("NOT full_run").select(*SET), gates.where("full_run").select(*SET)
    tests = test_nodes(graph.nodes)
    changed = classed.where("cls = 'node'").select(*SET, "node_id").distinct().join(narrow, SET, "left_semi")
    changed = work.checkpoint(changed)
    if uncertain is None:  # both closures in one loop, told apart by a flag
        seeds = changed.withColumn("dynamic", F.lit(False))
        dynamic = graph.nodes.where("has_dynamic").select("project", F.lit("").alias("change_set_id"), "node_id", F.lit(True).alias("dynamic"))
        both = reverse_closure(graph.edges, seeds.unionByName(dynamic), ["project"], ["change_set_id", "dynamic"])
        affected, uncertain = both.where("NOT dynamic").select(*SET, "node_id"), both.where("dynamic").select("project", "node_id")
    else:
        affected = reverse_closure(graph.edges, changed, ["project"], ["change_set_id"])
    maybe = uncertain.join(tests, ["project", "node_id"], "left_semi")
    maybe = narrow.join(maybe, "project").select(*SET, "node_id")
    affected = affected.join(tests, ["project", "node_id"], "left_semi").select(*SET, "node_id")
    only = work.checkpoint(maybe.join(affected, [*SET, "node_id"], "left_anti"))
    parts = [
        changed.withColumn("kind", F.lit("changed")),
        affected.withColumn("kind", F.lit("target")),
        only.withColumn("kind", F.lit("target")),
        only.withColumn("kind", F.lit("uncertain")),
        full.join(tests, "project").select(*SET, "node_id").withColumn("kind", F.lit("target")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return gates, out


def compute(graph: Graph, changes: DataFrame, change_sets: DataFrame | None = None, uncertain: DataFrame | None = None) -> DataFrame:
    """``schema.IMPACT``: a row for each change set, its lists sorted by bytes and empty rather than null."""
    gates, rows = impact_rows(graph, changes, change_sets, uncertain)
    pick = lambda k: F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("node_id"))))
    lists = rows.groupBy(*SET).agg(pick("target").alias("targets"), pick("changed").alias("changed_targets"), pick("uncertain").alias("uncertain_targets"))
    none = F.array().cast("array<string>")
    out = gates.join(lists, SET, "left")
    return out.select(*SET, "full_run", "full_run_reasons", *[F.coalesce(c, none).alias(c) for c in ("targets", "changed_targets", "uncertain_targets")])
