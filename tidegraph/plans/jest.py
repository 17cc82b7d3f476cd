"""The graph of a JavaScript or TypeScript project: a node a file."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsscan, paths, rules
from ..operators.graph import Graph, clean_edges, unique_files, upsert_nodes
from ..sources.manifests import alias_rules
from ..sources.tree import sources

#: What a specifier may lack, in the order in which it is tried: configuration of the resolver, not part of the graph's rules.
ENDINGS = ("", ".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs", ".css", ".json", "/index.tsx", "/index.ts", "/index.jsx", "/index.js", "/index.mjs", "/index.cjs", "/index.json")
SCAN = "project string, path string, kind string, value string"
GROUP = re.compile(r"\$(\d+)")


def scanned(files: DataFrame) -> DataFrame:
    """``(project, path, kind, value)``: rows of kind import (a specifier), template (a prefix) and opaque."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, path, content in zip(b["project"], b["path"], b["content"], strict=True):
                src = content or b""
                s = jsscan.scan(src)
                rows += [(project, path, "import", x) for x in dict.fromkeys([*jsscan.static_imports(src), *s.literals])]
                rows += [(project, path, "template", prefix) for _, _, prefix in s.calls]
                rows += [(project, path, "opaque", None)] * s.opaque
            yield pd.DataFrame(rows, columns=["project", "path", "kind", "value"])

    return files.select("project", "path", "content").mapInPandas(run, SCAN)


def expand(template: str, root: str, match: re.Match) -> str:
    """A rule's target for a match: <rootDir> and $n filled in, groups that there are not as nothing."""
    groups = [match[0], *match.groups("")]
    return GROUP.sub(lambda m: groups[int(m[1])] if int(m[1]) < len(groups) else "", template.replace("<rootDir>", root))


def alias_candidates(imports: DataFrame, rules_: DataFrame) -> DataFrame:
    """``(project, src, spec, rule_ord, target_ord, target)`` for each rule whose pattern is found in a specifier.

    A project's rules come to its distinct specifiers as one array, so specifiers are not multiplied by rules before a rule matches.
    """
    packed = rules_.groupBy("project").agg(F.array_sort(F.collect_list(F.struct("rule_ord", "target_ord", "pattern", "template"))).alias("rules"))
    specs = imports.select("project", "spec").distinct().join(packed, "project")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled: dict[str, re.Pattern] = {}
        for b in batches:
            rows = []
            for project, spec, own in zip(b["project"], b["spec"], b["rules"], strict=True):
                for r in own:
                    if r["pattern"] not in compiled:
                        compiled[r["pattern"]] = re.compile(r["pattern"])
                    m = compiled[r["pattern"]].search(spec)
                    if m:
                        rows.append((project, spec, r["rule_ord"], r["target_ord"], expand(r["template"], project, m)))
            yield pd.DataFrame(rows, columns=["project", "spec", "rule_ord", "target_ord", "target"])

    found = specs.mapInPandas(run, "project string, spec string, rule_ord int, target_ord int, target string")
    return imports.join(found, ["project", "spec"])


def config_aliases(files: DataFrame) -> DataFrame:
    """Rules ``schema.ALIAS_RULES`` from the paths of tsconfig.json, after the alias rules; one star a pattern."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for project, text in zip(b["project"], b["text"], strict=True):
                try:
                    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
                    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain)).get("compilerOptions", {})
                except ValueError:
                    continue
                base = "/".join(x for x in ("<rootDir>", options.get("baseUrl", ".").strip("./")) if x)
                for i, (pattern, targets) in enumerate(options.get("paths", {}).items()):
                    regex = "^" + re.escape(pattern).replace(r"\*", "(.*)") + r"\Z"
                    rows += [(project, 100_000 + i, regex, j, f"{base}/{t.removeprefix('./').replace('*', '$1')}") for j, t in enumerate(targets)]
            yield pd.DataFrame(rows, columns=["project", "rule_ord", "pattern", "target_ord", "template"])

    own = files.where((F.col("dir") == F.col("project")) & (F.col("base") == "tsconfig.json")).select("project", F.col("content").cast("string").alias("text"))
    return own.mapInPandas(run, "project string, rule_ord int, pattern string, target_ord int, template string")


def with_endings(target: Column) -> Column:
    """The paths that a target may stand for, with their rank; .js may also stand for its TypeScript source."""
    names = [F.concat(target, F.lit(e)) for e in ENDINGS]
    names += [F.when(F.endswith(target, F.lit(js)), F.concat(F.regexp_replace(target, re.escape(js) + r"\z", ""), F.lit(ts))) for js, ts in ((".js", ".ts"), (".js", ".tsx"), (".jsx", ".tsx"), (".mjs", ".mts"), (".cjs", ".cts"))]
    return F.array(*names)


def resolved(imports: DataFrame, rules_: DataFrame, files: DataFrame) -> DataFrame:
    """``(project, src, dst)``: the first that exists of the aliases' targets in the order of rules, then the specifier itself if it is a path."""
    aliased = alias_candidates(imports, rules_).select("project", "src", "spec", F.struct("rule_ord", "target_ord").alias("rank"), "target")
    own = imports.where(F.rlike("spec", F.lit(r"^(\.{1,2}(/|\z)|/)")))
    own = own.select("project", "src", "spec", F.struct(F.lit(2**31 - 1).alias("rule_ord"), F.lit(0).alias("target_ord")).alias("rank"), F.when(F.startswith("spec", F.lit("/")), F.col("spec")).otherwise(paths.join(paths.parent(F.col("src")), F.col("spec"))).alias("target"))
    relative = F.when(F.startswith("target", F.lit("/")), F.col("target")).otherwise(paths.join(F.col("project"), F.col("target")))
    c = aliased.withColumn("target", relative).unionByName(own).withColumn("target", paths.normalize(F.col("target")))
    c = c.select("project", "src", "spec", "rank", F.posexplode(with_endings(F.col("target"))).alias("ending", "path")).where("path IS NOT NULL")
    hit = c.join(files.select("project", "path").distinct(), ["project", "path"])
    return hit.groupBy("project", "src", "spec").agg(F.min_by("path", F.struct("rank", "ending")).alias("dst")).select("project", "src", "dst")


def template_dirs(templates: DataFrame) -> DataFrame:
    """``(project, src, dir)``: the folder whose files a template call may name."""
    at, prefix = paths.parent(F.col("src")), F.col("prefix")
    joined = paths.normalize(paths.join(at, prefix))
    whole = F.when(F.startswith(prefix, F.lit("/")), paths.normalize(prefix)).otherwise(joined)
    d = F.when(prefix == "", at).when(F.endswith(prefix, F.lit("/")), whole).otherwise(paths.parent(whole))
    return templates.select("project", "src", d.alias("dir"))


def glob_edges(dirs: DataFrame, files: DataFrame) -> DataFrame:
    """``(project, src, dst)``: to every file below the folder, the caller left out. Files' folders become rows and meet the calls' by equality."""
    up = files.select("project", F.col("path").alias("dst"), F.explode(paths.ancestors(F.col("path"))).alias("dir"))
    return dirs.distinct().join(up, ["project", "dir"]).where("src <> dst").select("project", "src", "dst").distinct()


def build(files: DataFrame, strict: bool = True) -> Graph:
    """Unless ``strict``, a file is dynamic when any of its template calls matches no file, not only when all fail."""
    own = sources(files, "jest")
    s = scanned(own)
    imports = s.where("kind = 'import'").select("project", F.col("path").alias("src"), F.col("value").alias("spec"))
    inside = files.where(~rules.skipped("jest", paths.relative_or_self(F.col("project"), F.col("path"))))
    direct = resolved(imports, alias_rules(files).unionByName(config_aliases(files)), inside)
    dirs = template_dirs(s.where("kind = 'template'").select("project", F.col("path").alias("src"), F.col("value").alias("prefix")))
    globs = glob_edges(dirs, own)
    opaque = s.where("kind = 'opaque'").select("project", F.col("path").alias("node_id"))
    if strict:
        missed = dirs.select("project", "src").distinct().join(globs, ["project", "src"], "left_anti")
    else:
        up = own.select("project", F.explode(paths.ancestors(F.col("path"))).alias("dir")).distinct()
        missed = dirs.join(up, ["project", "dir"], "left_anti")
    dynamic = opaque.unionByName(missed.select("project", F.col("src").alias("node_id"))).distinct().withColumn("has_dynamic", F.lit(True))
    edges = clean_edges(direct.unionByName(globs))
    p = F.col("path")
    rows = own.select("project", p.alias("node_id"), rules.test_file("jest", p).alias("has_tests"))
    other = edges.select("project", F.col("dst").alias("node_id")).distinct().withColumn("has_tests", rules.test_file("jest", F.col("node_id")))
    nodes = upsert_nodes(rows.unionByName(other).join(dynamic, ["project", "node_id"], "left"))
    node_files = unique_files(nodes.select("project", "node_id", F.col("node_id").alias("path"), paths.parent(F.col("node_id")).alias("dir")))
    return Graph("jest", nodes, node_files, edges)
