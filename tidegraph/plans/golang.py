"""The graph of Go modules: a node a package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import work
from ..functions import paths, rules
from ..operators.graph import Graph, clean_edges, unique_files, upsert_nodes
from ..sources.manifests import go_module_dirs, go_packages
from ..sources.tree import sources

IMPORT_BLOCK = r"(?s)\bimport\s*\(([^)]*)\)"
IMPORT_LINE = r"(?m)^\s*import\s+(?:[\w.]+\s+)?[\"`]([^\"`\n]+)[\"`]"
QUOTED = r"[\"`]([^\"`\n]+)[\"`]"


class PackageError(ValueError):
    """A listed package has an error, so its graph can't be trusted."""


def check(packages: DataFrame) -> None:
    """Raise with the first error of the first package that has some."""
    bad = packages.where(F.size("Errors") > 0).groupBy().agg(F.min(F.struct("project", "ID", F.element_at("Errors", 1).alias("error"))).alias("e")).first()["e"]
    if bad:
        raise PackageError(f"package {bad['ID']} in {bad['project']}: {bad['error']}")


def target(strict: bool) -> Column:
    """The node of a listed package. Variants of a test belong to the tested package; unless ``strict``, recompiled packages stay themselves."""
    tested = paths.real_target(F.col("ID"), F.col("ImportPath"))
    return tested if strict else F.when(F.endswith("ImportPath", F.lit("_test")) & F.contains("ID", F.lit(" [")), tested).otherwise(F.regexp_replace("ImportPath", r" \[.*\]\z", ""))


def from_listing(exported: DataFrame, strict: bool = False) -> Graph:
    """From package listings ``(project, content)``: main-module packages without test binaries; an error in any stops it."""
    p = work.checkpoint(go_packages(exported))
    check(p)
    binary = F.endswith("ID", F.lit(".test")) & ~F.contains("ID", F.lit(" ["))
    own = p.where(F.col("Main") & ~binary).withColumn("node_id", target(strict))
    files = own.select("project", "node_id", F.explode("GoFiles").alias("path")).withColumn("dir", paths.parent(F.col("path")))
    main = p.where("Main").select("project", F.col("ID").alias("to"), target(strict).alias("dst")).distinct()
    links = own.select("project", F.col("node_id").alias("src"), F.explode("Imports").alias("to")).join(main, ["project", "to"])
    return assembled(own.select("project", "node_id"), files, links)


def assembled(nodes: DataFrame, files: DataFrame, links: DataFrame) -> Graph:
    tests = files.select("project", "node_id", rules.test_file("go", F.col("path")).alias("has_tests"))
    rows = nodes.withColumn("has_tests", F.lit(False)).unionByName(tests).withColumn("has_dynamic", F.lit(False))
    return Graph("go", upsert_nodes(rows), unique_files(files), clean_edges(links))


def from_sources(files: DataFrame) -> Graph:
    """Without a listing: import paths from go.mod and folders, imports from the sources' import declarations, those of tests included."""
    text = F.col("content").cast("string")
    mods = files.where("base = 'go.mod'").select("project", F.col("dir").alias("mod_dir"), F.regexp_extract(text, r"(?m)^\s*module\s+\"?([^\s\"]+)", 1).alias("module"))
    members = go_module_dirs(files)
    at = F.when(F.col("dir") == ".", F.col("project")).otherwise(F.concat_ws("/", "project", "dir"))
    mods = mods.join(members.select("project", at.alias("mod_dir")), ["project", "mod_dir"], "left_semi")
    up = sources(files, "go").withColumn("mod_dir", F.explode(F.array_prepend(paths.ancestors(F.col("dir")), F.col("dir")))).join(mods, ["project", "mod_dir"])
    best = up.groupBy("project", "path").agg(F.max_by(F.struct("mod_dir", "module", "dir", text.alias("text")), F.length("mod_dir")).alias("m")).select("project", "path", "m.*")
    rel = paths.relative_or_self(F.col("mod_dir"), F.col("dir"))
    own = best.withColumn("node_id", F.when(F.col("dir") == F.col("mod_dir"), F.col("module")).otherwise(F.concat_ws("/", "module", rel)))
    code = F.regexp_replace("text", r"(?s)/\*.*?\*/|(?m)^\s*//[^\n]*", "")
    blocks = F.array_join(F.regexp_extract_all(code, F.lit(IMPORT_BLOCK), F.lit(1)), "\n")
    found = F.array_union(F.regexp_extract_all(blocks, F.lit(QUOTED), F.lit(1)), F.regexp_extract_all(code, F.lit(IMPORT_LINE), F.lit(1)))
    links = own.select("project", F.col("node_id").alias("src"), F.explode(found).alias("dst"))
    nodes = own.select("project", "node_id").distinct()
    inside = links.join(nodes.withColumnRenamed("node_id", "dst"), ["project", "dst"], "left_semi")
    return assembled(nodes, own.select("project", "node_id", "path", "dir"), inside)


def build(files: DataFrame, exported: DataFrame | None = None, strict: bool = False) -> Graph:
    return from_sources(files) if exported is None else from_listing(exported, strict)


def patterns(files: DataFrame) -> DataFrame:
    """``(project, patterns)``: the package patterns of a full run. A project with neither go.mod nor go.work has no row."""
    own = files.where((F.col("dir") == F.col("project")) & F.col("base").isin("go.mod", "go.work")).groupBy("project").agg(F.bool_or(F.col("base") == "go.mod").alias("module"))
    dirs = go_module_dirs(files).join(own, "project").where("NOT module OR dir = '.'")
    return dirs.groupBy("project").agg(F.array_sort(F.collect_set(paths.go_pattern(F.col("dir")))).alias("patterns"))
