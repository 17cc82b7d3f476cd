"""Manifests and exported listings as tables."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import ALIAS_RULES

CARGO_METADATA = "workspace_root string, packages array<struct<id:string,name:string,manifest_path:string>>, workspace_members array<string>, resolve struct<nodes:array<struct<id:string,deps:array<struct<name:string,pkg:string>>>>>"
GO_PACKAGE = "ID string, ImportPath string, ForTest string, Dir string, Main boolean, GoFiles array<string>, Imports array<string>, Errors array<string>"
PACKAGE_JSON = "dependencies map<string,string>, devDependencies map<string,string>, jest string"

#: Syntax that the rules' regex dialect has not: look-around, back-references, atomic and possessive parts.
FOREIGN = re.compile(r"\(\?(?:[=!>]|<[=!])|\\[1-9]|[*+?}]\+")


def package_json(files: DataFrame) -> DataFrame:
    """``(project, dependencies, devDependencies, jest)`` of the projects' own package.json, ``jest`` as its raw text."""
    f = files.where((F.col("dir") == F.col("project")) & (F.col("base") == "package.json"))
    return f.select("project", F.from_json(F.col("content").cast("string"), PACKAGE_JSON).alias("p")).select("project", "p.*")


def compiles(pattern: str) -> bool:
    try:
        re.compile(pattern)
    except re.error:
        return False
    return not FOREIGN.search(pattern)


def ordered_rules(text: str | None) -> list[tuple[int, str, int, str]]:
    """The alias rules of a config text, in the order in which they stand; a rule whose pattern doesn't compile is left out."""
    mapper = json.loads(text).get("moduleNameMapper") if text else None
    if not mapper:
        return []
    if not isinstance(mapper, dict):
        raise ValueError("moduleNameMapper is not an object")
    out = []
    for i, (pattern, targets) in enumerate(mapper.items()):
        targets = [targets] if isinstance(targets, str) else targets
        if not isinstance(targets, list) or not all(isinstance(t, str) for t in targets):
            raise ValueError("a moduleNameMapper target is neither a string nor a list of them")
        if compiles(pattern):
            out += [(i, pattern, j, t) for j, t in enumerate(targets)]
    return out


def alias_rules(files: DataFrame) -> DataFrame:
    """``schema.ALIAS_RULES`` of each project: from jest.config.json where that file exists, otherwise from package.json's jest field."""
    own = files.where((F.col("dir") == F.col("project")) & F.col("base").isin("jest.config.json", "package.json"))
    g = own.groupBy("project").agg(
        F.max(F.when(F.col("base") == "jest.config.json", F.col("content").cast("string"))).alias("config"),
        F.max(F.when(F.col("base") == "package.json", F.from_json(F.col("content").cast("string"), PACKAGE_JSON)["jest"])).alias("field"),
        F.bool_or(F.col("base") == "jest.config.json").alias("has_config"),
    )

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(p, *r) for p, t in zip(b["project"], b["text"], strict=True) for r in ordered_rules(t)]
            yield pd.DataFrame(rows, columns=["project", "rule_ord", "pattern", "target_ord", "template"])

    return g.select("project", F.when(F.col("has_config"), F.col("config")).otherwise(F.col("field")).alias("text")).mapInPandas(parse, ALIAS_RULES)


def cargo_metadata(exported: DataFrame) -> DataFrame:
    """Metadata documents ``(project, content)`` as columns."""
    return exported.select("project", F.from_json(F.col("content").cast("string"), CARGO_METADATA).alias("m")).select("project", "m.*")


def go_packages(exported: DataFrame) -> DataFrame:
    """Package listings ``(project, content)``, a JSON array of packages each, as one row a package."""
    return exported.select("project", F.explode(F.from_json(F.col("content").cast("string"), f"array<struct<{GO_PACKAGE.replace(' ', ':').replace(',:', ',')}>>")).alias("p")).select("project", "p.*")


def go_module_dirs(files: DataFrame) -> DataFrame:
    """``(project, dir)`` of the modules that a go.work names, or of the project itself if it has a go.mod."""
    text = F.col("content").cast("string")
    uses = F.regexp_extract_all(F.regexp_replace(text, r"//[^\n]*", ""), F.lit(r"(?m)^\s*(?:use\s+)?(\.{1,2}(?:/[^\s()]*)?)\s*$"), F.lit(1))
    own = files.where(F.col("dir") == F.col("project"))
    work = own.where("base = 'go.work'").select("project", F.explode(uses).alias("dir"))
    return own.where("base = 'go.mod'").select("project", F.lit(".").alias("dir")).unionByName(work).select("project", F.regexp_replace(F.regexp_replace("dir", r"^\./", ""), r"/\z", "").alias("dir")).distinct()
