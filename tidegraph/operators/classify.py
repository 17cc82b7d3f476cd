"""Which node a change belongs to, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules
from . import graph


def ordered_changes(changes: DataFrame) -> DataFrame:
    """Distinct paths of each change set at their first place; blanks are dropped, other space around a path is trimmed."""
    c = changes.withColumn("path", F.trim("path")).where("path <> ''")
    return c.groupBy("project", "change_set_id", "path").agg(F.min("ord").alias("ord"))


def concatenated(first: DataFrame, second: DataFrame) -> DataFrame:
    """The changes of ``second`` after those of ``first``."""
    last = first.groupBy("project", "change_set_id").agg((F.max("ord") + 1).alias("from"))
    moved = second.join(last, ["project", "change_set_id"], "left").withColumn("ord", F.col("ord") + F.coalesce("from", F.lit(0)))
    return first.select("project", "change_set_id", "ord", "path").unionByName(moved.select("project", "change_set_id", "ord", "path"))


def with_owner(changes: DataFrame, node_files: DataFrame) -> DataFrame:
    """``changes`` with ``node_id``: the owner of the file itself, else the one node that owns its folder, else null.

    Both look-ups aggregate only those files that some change names or has beside it.
    """
    c = changes.withColumn("dir", paths.parent(F.col("path")))
    by_path = node_files.join(c.select("project", "path").distinct(), ["project", "path"], "left_semi")
    by_dir = node_files.join(c.select("project", "dir").distinct(), ["project", "dir"], "left_semi")
    exact = graph.exact_owners(by_path).withColumnRenamed("node_id", "exact")
    near = graph.dir_owners(by_dir).withColumnRenamed("node_id", "near")
    joined = c.join(exact, ["project", "path"], "left").join(near, ["project", "dir"], "left")
    return joined.withColumn("node_id", F.coalesce("exact", "near")).drop("exact", "near", "dir")


def classified(owned: DataFrame, is_full, is_ignorable) -> DataFrame:
    """``cls`` of changes with an owner: the first that holds of full, node, ignored, unresolved."""
    cls = F.when(is_full, "full").when(F.col("node_id").isNotNull(), "node").when(is_ignorable, "ignored").otherwise("unresolved")
    return owned.withColumn("cls", cls)


def classify(changes: DataFrame, node_files: DataFrame, analyzer: str) -> DataFrame:
    """``(project, change_set_id, ord, path, node_id, cls)`` under the rules of ``analyzer``."""
    p = F.col("path")
    owned = with_owner(ordered_changes(changes), node_files)
    return classified(owned, rules.full_run(analyzer, p), rules.ignorable(analyzer, p)).select("project", "change_set_id", "ord", "path", "node_id", "cls")


def gate(classed: DataFrame) -> DataFrame:
    """``(project, change_set_id, full_run, full_run_reasons)``: reasons are the full-run files, then the unresolved ones, each in order."""
    reason = F.col("cls").isin("full", "unresolved")
    entry = F.when(reason, F.struct(F.when(F.col("cls") == "full", 0).otherwise(1).alias("rank"), "ord", "path"))
    g = classed.groupBy("project", "change_set_id").agg(F.bool_or(reason).alias("full_run"), F.array_sort(F.collect_list(entry)).alias("r"))
    return g.select("project", "change_set_id", "full_run", F.transform("r", lambda x: x["path"]).alias("full_run_reasons"))
