"""Commands that would run the targets, as array columns; and the one function that runs a command."""

from __future__ import annotations

import subprocess
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import paths


def words(*items: str) -> Column:
    return F.array(*map(F.lit, items)) if items else F.array().cast("array<string>")


def go_command(targets: Column, extra: Sequence[str] = ()) -> Column:
    """Extra arguments stand before the packages."""
    return F.concat(words("go", "test", *extra), targets)


def jest_pattern(targets: Column) -> Column:
    """One pattern that matches exactly the targets' paths."""
    return F.array_join(F.transform(targets, lambda t: F.concat(F.lit("^"), paths.quote(t), F.lit("$"))), "|")


def jest_command(targets: Column, extra: Sequence[str] = (), local: Column | None = None) -> Column:
    """``local`` is the project's own binary, null where there is none; no pattern without targets."""
    binary = words("npx", "jest") if local is None else F.when(local.isNotNull(), F.array(local)).otherwise(words("npx", "jest"))
    return F.concat(binary, F.when(F.size(targets) > 0, F.array(jest_pattern(targets))).otherwise(words()), words(*extra))


def pytest_command(targets: Column, extra: Sequence[str] = (), venv: Column | None = None, on_path: str | None = None, python: str | None = None) -> Column:
    """A virtual environment's binary, else the one on the path, else the interpreter's module, else the plain name."""
    other = words(on_path) if on_path else words(python, "-m", "pytest") if python else words("pytest")
    binary = other if venv is None else F.when(venv.isNotNull(), F.array(venv)).otherwise(other)
    return F.concat(binary, targets, words(*extra))


def cargo_command(targets: Column, extra: Sequence[str] = ()) -> Column:
    return F.concat(words("cargo", "test"), F.flatten(F.transform(targets, lambda t: F.array(F.lit("-p"), t))), words(*extra))


def command(analyzer: str, targets: Column, extra: Sequence[str] = (), **options) -> Column:
    return {"go": go_command, "jest": jest_command, "pytest": pytest_command, "cargo": cargo_command}[analyzer](targets, extra, **options)


def local_binaries(files, analyzer: str):
    """``(project, binary)`` from ``files``: the project's own runner, of several the first in the fixed order."""
    places = {"jest": ["node_modules/.bin/jest"], "pytest": [f"{v}/bin/pytest" for v in (".venv", "venv", "env")]}[analyzer]
    rank = F.lit(None).cast("int")
    for i, p in enumerate(places):
        rank = F.coalesce(rank, F.when(F.col("path") == F.concat_ws("/", "project", F.lit(p)), F.lit(i)))
    return files.withColumn("rank", rank).where("rank IS NOT NULL").groupBy("project").agg(F.min_by("path", "rank").alias("binary"))


def run(argv: Sequence[str], cwd: str | None = None) -> int:
    """Run a command with this process's input and output; its exit status."""
    if not argv:
        raise ValueError("no command to run")
    return subprocess.run(list(argv), cwd=cwd).returncode
