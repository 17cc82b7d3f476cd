"""Changed files of a git tree, read by the driver: the lists are as long as a change, not as a repository."""

from __future__ import annotations

import os
import subprocess

from pyspark.sql import DataFrame, SparkSession

from ..schema import CHANGES


def run_git(folder: str, *args: str) -> list[str]:
    """The non-empty, NUL-separated names that a git command prints; its complaint is part of the error."""
    done = subprocess.run(["git", *args], cwd=folder, capture_output=True)
    if done.returncode:
        raise RuntimeError(f"git {' '.join(args)}: {done.stderr.decode(errors='replace').strip()}")
    return [x.decode(errors="surrogateescape") for x in done.stdout.split(b"\0") if x.strip()]


def repo_root(folder: str) -> str:
    done = subprocess.run(["git", "rev-parse", "--show-toplevel"], cwd=folder, capture_output=True, text=True)
    root = done.stdout.strip()
    if done.returncode or not root:
        raise RuntimeError(f"no git repository at {folder}: {done.stderr.strip()}")
    return root


def changed_files(root: str, base: str | None = None) -> list[str]:
    """Absolute paths in git's order, each once: against HEAD with untracked files after, or since the merge base with ``base``. Names are not quoted by git."""
    if base:
        names = run_git(root, "diff", "--name-only", "-z", f"{base}...HEAD")
    else:
        names = run_git(root, "diff", "--name-only", "-z", "HEAD") + run_git(root, "ls-files", "--others", "--exclude-standard", "-z")
    return list(dict.fromkeys(os.path.join(root, x) for x in names))


def changes(spark: SparkSession, root: str, base: str | None = None, project: str | None = None, change_set_id: str = "worktree") -> DataFrame:
    rows = [(project or root, change_set_id, i, p) for i, p in enumerate(changed_files(root, base))]
    return spark.createDataFrame(rows, CHANGES)
