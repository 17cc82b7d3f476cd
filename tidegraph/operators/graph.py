"""Graph tables: nodes, files and edges out of raw rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Graph:
    """The tables of ``schema``; ``analyzer`` names the rules that changes are judged by."""

    analyzer: str
    nodes: DataFrame
    node_files: DataFrame
    edges: DataFrame


def upsert_nodes(rows: DataFrame) -> DataFrame:
    """One row a node: flags of several rows are OR-ed, a null flag counts as false."""
    flags = [F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in ("has_tests", "has_dynamic")]
    return rows.where("node_id IS NOT NULL").groupBy("project", "node_id").agg(*flags)


def unique_files(rows: DataFrame) -> DataFrame:
    return rows.select("project", "node_id", "path", "dir").where("node_id IS NOT NULL AND path IS NOT NULL").distinct()


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct edges without self edges; with ``nodes`` only those whose two ends are nodes."""
    e = edges.select("project", "src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct()
    if nodes is not None:
        for end in ("src", "dst"):
            e = e.join(nodes.select("project", F.col("node_id").alias(end)), ["project", end], "left_semi")
    return e.select("project", "src", "dst")


def exact_owners(node_files: DataFrame) -> DataFrame:
    """``(project, path, node_id)``; of several nodes that claim a file the smallest id."""
    return node_files.groupBy("project", "path").agg(F.min("node_id").alias("node_id"))


def dir_owners(node_files: DataFrame) -> DataFrame:
    """``(project, dir, node_id)`` for folders whose files belong to exactly one node. Sums of min and max: no set of ids is gathered."""
    g = node_files.groupBy("project", "dir").agg(F.min("node_id").alias("node_id"), F.max("node_id").alias("last"))
    return g.where("node_id = last").select("project", "dir", "node_id")


def importers(edges: DataFrame) -> DataFrame:
    """``(project, dst, n_importers, importers)``: the reverse index, for diagnosis; closures don't need it."""
    g = edges.where("src <> dst").select("project", "src", "dst").distinct().groupBy("project", "dst")
    return g.agg(F.count("*").alias("n_importers"), F.array_sort(F.collect_list("src")).alias("importers"))


def longest_prefix_owner(files: DataFrame, owners: DataFrame) -> DataFrame:
    """``(project, path, owner)``: of ``owners(project, dir, owner)`` the one with the longest folder above each file; files under none are left out.

    Folders above a file become rows and meet the owners by equality, instead of each file being tried against each owner.
    """
    from ..functions import paths

    up = files.select("project", "path", F.explode(F.array_prepend(paths.ancestors(F.col("path")), F.col("path"))).alias("dir"))
    return up.join(owners, ["project", "dir"]).groupBy("project", "path").agg(F.max_by("owner", F.struct(F.length("dir"), "owner")).alias("owner"))
