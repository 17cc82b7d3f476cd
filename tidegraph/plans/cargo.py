"""The graph of a Rust workspace: a node a crate."""

from __future__ import annotations

import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, rules
from ..operators.graph import Graph, clean_edges, longest_prefix_owner, unique_files, upsert_nodes
from ..sources.manifests import cargo_metadata
from ..sources.tree import sources

TABLES = ("dependencies", "dev-dependencies", "build-dependencies")


def manifest(text: str) -> tuple[str | None, list[str]]:
    """The crate's name, and the folders of its dependencies by path, of any kind, relative to it."""
    try:
        doc = tomllib.loads(text)
    except tomllib.TOMLDecodeError:
        return None, []
    tables = [doc, *doc.get("target", {}).values()]
    deps = [d["path"] for t in tables for k in TABLES for d in t.get(k, {}).values() if isinstance(d, dict) and "path" in d]
    return doc.get("package", {}).get("name"), deps


def from_manifests(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(project, owner, dir)`` and ``(project, src, dst)`` from the manifests alone: members are all crates below the root."""
    own = files.where((F.col("base") == "Cargo.toml") & ~rules.skipped("cargo", paths.relative_or_self(F.col("project"), F.col("path"))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, at, content in zip(b["project"], b["dir"], b["content"], strict=True):
                name, deps = manifest((content or b"").decode("utf-8", errors="replace"))
                if name:
                    rows += [(project, name, at, None), *((project, name, at, f"{at}/{d}") for d in deps)]
            yield pd.DataFrame(rows, columns=["project", "owner", "dir", "dep"])

    m = own.select("project", "dir", "content").mapInPandas(run, "project string, owner string, dir string, dep string")
    crates = m.where("dep IS NULL").select("project", "owner", "dir")
    deps = m.where("dep IS NOT NULL").select("project", F.col("owner").alias("src"), paths.normalize(F.col("dep")).alias("dir"))
    return crates, deps.join(crates.withColumnRenamed("owner", "dst"), ["project", "dir"]).select("project", "src", "dst")


def from_metadata(exported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The same from exported metadata documents ``(project, content)``: members only, dependencies of every kind."""
    m = cargo_metadata(exported)
    members = m.select("project", F.explode("workspace_members").alias("id")).distinct()
    packages = m.select("project", F.explode("packages").alias("p")).select("project", "p.id", F.col("p.name").alias("owner"), paths.parent(F.col("p.manifest_path")).alias("dir"))
    packages = packages.join(members, ["project", "id"], "left_semi")
    name = packages.select("project", "id", "owner")
    deps = m.select("project", F.explode("resolve.nodes").alias("n")).select("project", F.col("n.id").alias("id"), F.explode("n.deps.pkg").alias("to"))
    deps = deps.join(name.withColumnRenamed("owner", "src"), ["project", "id"]).drop("id").withColumnRenamed("to", "id")
    return packages.select("project", "owner", "dir"), deps.join(name.withColumnRenamed("owner", "dst"), ["project", "id"]).select("project", "src", "dst")


def build(files: DataFrame, exported: DataFrame | None = None) -> Graph:
    crates, edges = from_manifests(files) if exported is None else from_metadata(exported)
    own = sources(files, "cargo")
    owned = longest_prefix_owner(own, crates).withColumnRenamed("owner", "node_id")
    marked = own.select("project", "path", F.rlike(F.col("content").cast("string"), F.lit(rules.RUST_TEST)).alias("has_tests")).join(owned, ["project", "path"])
    below = files.select("project", F.explode(paths.ancestors(F.col("path"))).alias("d")).where(paths.base(F.col("d")) == "tests").distinct()
    folders = crates.join(below.select("project", paths.parent(F.col("d")).alias("dir")), ["project", "dir"], "left_semi").select("project", F.col("owner").alias("node_id"), F.lit(True).alias("has_tests"))
    rows = crates.select("project", F.col("owner").alias("node_id"), F.lit(False).alias("has_tests")).unionByName(folders).unionByName(marked.select("project", "node_id", "has_tests"))
    node_files = owned.withColumn("dir", paths.parent(F.col("path")))
    return Graph("cargo", upsert_nodes(rows.withColumn("has_dynamic", F.lit(False))), unique_files(node_files), clean_edges(edges))
