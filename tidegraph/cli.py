"""``python -m tidegraph test [--base REF] [--dry-run] [--all] [-v] [-- ARGS]``: run the tests that a change can affect."""

from __future__ import annotations

import argparse
import os
import shutil
import sys
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import work
from .functions import rules
from .operators import commands, detect, report
from .operators.impact import compute, test_nodes
from .plans import ANALYZERS
from .sources import git, tree


@dataclass(frozen=True)
class Options:
    base: str | None = None
    dry_run: bool = False
    all: bool = False
    verbose: bool = False
    extra: list[str] = field(default_factory=list)


def parse(argv: list[str]) -> Options:
    """Everything after ``--`` goes to the test runner."""
    own, extra = (argv[: argv.index("--")], argv[argv.index("--") + 1 :]) if "--" in argv else (argv, [])
    p = argparse.ArgumentParser(prog="tidegraph", description="Runs the tests that a change can affect.")
    t = p.add_subparsers(dest="command", required=True).add_parser("test")
    t.add_argument("--base", default=None, help="compare with the merge base of this reference instead of HEAD")
    t.add_argument("--dry-run", action="store_true", help="print, but run nothing")
    t.add_argument("--all", action="store_true", help="run everything")
    t.add_argument("-v", "--verbose", action="store_true", help="list the changed files")
    a = p.parse_args(own)
    return Options(a.base, a.dry_run, a.all, a.verbose, extra)


def argv_for(spark: SparkSession, analyzer: str, root: str, targets: list[str], extra: list[str]) -> list[str]:
    options = {}
    if analyzer in ("jest", "pytest"):
        places = {"jest": ["node_modules/.bin/jest"], "pytest": [f"{v}/bin/pytest" for v in (".venv", "venv", "env")]}[analyzer]
        found = next((p for x in places if os.path.isfile(p := os.path.join(root, x))), None)
        options = {"local" if analyzer == "jest" else "venv": F.lit(found).cast("string")}
        if analyzer == "pytest":
            options |= {"on_path": shutil.which("pytest"), "python": shutil.which("python3") or shutil.which("python")}
    row = spark.createDataFrame([(targets,)], "targets array<string>")
    return row.select(commands.command(analyzer, F.col("targets"), extra, **options).alias("c")).first()["c"]


def run(spark: SparkSession, folder: str, options: Options, out=print) -> int:
    """One run; the exit status of the tests, or 0."""
    folder = os.path.abspath(folder)
    files = tree.read_tree(spark, folder)
    names = [*rules.JEST_CONFIGS, "package.json", "go.mod", "go.work", "Cargo.toml", "pytest.ini", "conftest.py", "tox.ini", "setup.cfg", "pyproject.toml", "requirements.txt", "requirements-dev.txt", "requirements-test.txt", "Pipfile"]
    found = detect.detected(detect.facts(files.where(F.col("base").isin(names)))).first()
    if found is None or found["analyzer"] is None:
        raise SystemExit(f"tidegraph: no supported project at {folder}")
    analyzer = ANALYZERS[found["analyzer"]]
    root = git.repo_root(folder)

    def finish(targets: list[str]) -> int:
        if options.dry_run:
            out("tidegraph: dry run, nothing is executed")
            return 0
        return commands.run(argv_for(spark, analyzer.name, folder, targets, options.extra), folder)

    if options.all:
        out(f"tidegraph: all tests were asked for ({analyzer.name})")
        patterns = analyzer.all_targets(files).first() if analyzer.all_targets and not options.dry_run else None
        return finish(list(patterns["patterns"]) if patterns else [])
    changed = git.changed_files(root, options.base)
    if not changed:
        out("tidegraph: no file has changed")
        return 0
    if options.verbose:
        out(f"tidegraph: changed files: {len(changed)}")
        for p in changed:
            out(f"  {report.relative_text(p, root)}")
    graph = analyzer.build(files)
    changes = spark.createDataFrame([(folder, "worktree", i, p) for i, p in enumerate(changed)], "project string, change_set_id string, ord int, path string")
    row = compute(graph, changes).first()
    for line in report.text(row, test_nodes(graph.nodes).count(), analyzer.name, root):
        out(line)
    return finish(row["targets"]) if row["full_run"] or row["targets"] else 0


def main(argv: list[str] | None = None) -> int:
    options = parse(sys.argv[1:] if argv is None else argv)
    spark = work.session(**{"spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": "8"})
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return run(spark, os.getcwd(), options)
    except (RuntimeError, ValueError) as e:
        print(f"tidegraph: {e}", file=sys.stderr)
        return 1
