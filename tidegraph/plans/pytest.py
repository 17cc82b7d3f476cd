"""The graph of a Python project: a node a file."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules
from ..functions.pyimports import aliases, imports
from ..operators.graph import Graph, clean_edges, unique_files, upsert_nodes
from ..sources.tree import sources


def modules(files: DataFrame) -> DataFrame:
    """``files`` with ``module`` (null for a root's own __init__.py) and ``package``. Files below src/, where the project has it, are named from there."""
    src = F.concat("project", F.lit("/src/"))
    root = F.when(F.startswith("path", src), F.concat("project", F.lit("/src"))).otherwise(F.col("project"))
    m = files.withColumn("module", paths.module_name(paths.relative_or_self(root, F.col("path"))))
    return m.withColumn("package", paths.package_of(F.col("module"), F.col("base") == "__init__.py"))


def registry(files: DataFrame) -> DataFrame:
    """``(project, module, path)``: of several files with one module name the smallest path."""
    return files.where("module IS NOT NULL").groupBy("project", "module").agg(F.min("path").alias("path"))


def targets(files: DataFrame, strict: bool = True) -> DataFrame:
    """``(project, path, target, dynamic)``: a row for each imported name, or one with a null target. Unless ``strict``, imported submodules count too."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, package, content in zip(b["project"], b["path"], b["package"], b["content"], strict=True):
                names, dynamic = imports(content or b"", package)
                if not strict:
                    names = list(dict.fromkeys([*names, *aliases(content or b"", package)]))
                rows += [(project, path, t, dynamic) for t in names or [None]]
            yield pd.DataFrame(rows, columns=["project", "path", "target", "dynamic"])

    return files.select("project", "path", "package", "content").mapInPandas(run, "project string, path string, target string, dynamic boolean")


def resolved(targets_: DataFrame, registry_: DataFrame) -> DataFrame:
    """``(project, src, dst)``: each target's module, else the module one level up."""
    up = F.regexp_replace("target", r"\.[^.]*\z", "")
    t = targets_.where("target IS NOT NULL").select("project", F.col("path").alias("src"), "target").distinct()
    names = F.when(F.contains("target", F.lit(".")), F.array(F.col("target"), up)).otherwise(F.array("target"))
    c = t.select("project", "src", "target", F.posexplode(names).alias("rank", "module")).join(registry_, ["project", "module"])
    return c.groupBy("project", "src", "target").agg(F.min_by("path", "rank").alias("dst")).select("project", "src", "dst")


def build(files: DataFrame, strict: bool = True) -> Graph:
    own = modules(sources(files, "pytest"))
    found = targets(own, strict)
    flags = found.groupBy("project", "path").agg(F.bool_or("dynamic").alias("has_dynamic"))
    p = F.col("path")
    nodes = upsert_nodes(flags.select("project", p.alias("node_id"), rules.test_file("pytest", p).alias("has_tests"), "has_dynamic"))
    return Graph("pytest", nodes, unique_files(own.withColumn("node_id", p)), clean_edges(resolved(found, registry(own))))
