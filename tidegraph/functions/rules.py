"""Rules of the four analyzers as data, and predicates made of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import RULES
from . import paths

# File names, extensions, folders and patterns that each tool defines.
FULL_RUN_NAMES = {
    "go": ("go.mod", "go.sum", "go.work", "go.work.sum"),
    "jest": (
        "package.json", "package-lock.json", "yarn.lock", "pnpm-lock.yaml",
        "jest.config.js", "jest.config.ts", "jest.config.mjs", "jest.config.cjs", "jest.config.json",
        "babel.config.js", "babel.config.cjs", "babel.config.mjs", "babel.config.json",
        ".babelrc", ".babelrc.js", ".babelrc.json", ".swcrc",
    ),
    "pytest": ("pyproject.toml", "setup.py", "setup.cfg", "pytest.ini", "tox.ini", "conftest.py", "Pipfile", "Pipfile.lock", "poetry.lock", "uv.lock"),
    "cargo": ("Cargo.toml", "Cargo.lock", "build.rs", "rust-toolchain", "rust-toolchain.toml"),
}
FULL_RUN_PREFIX_SUFFIX = {"jest": (("tsconfig", ".json"),), "pytest": (("requirements", ".txt"),)}
FULL_RUN_PARENT = {"cargo": ((".cargo", ("config.toml", "config")),)}
TRACKED_EXT = {"go": (".go",), "jest": (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"), "pytest": (".py",), "cargo": (".rs",)}
UNTRACKED_SUFFIX = {"jest": (".d.ts",)}
SKIPPED_DIRS = {
    "go": (),
    "jest": ("node_modules", ".git", "dist", "build", ".next", "out", "coverage", ".turbo", ".cache"),
    "pytest": (".git", "__pycache__", "node_modules", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".ruff_cache", "build", "dist", ".eggs", "site-packages"),
    "cargo": ("target", ".git"),
}
SKIPPED_DIR_SUFFIX = {"pytest": (".egg-info",)}
TEST_FILE = {"go": r"_test\.go\z", "jest": r"\.(test|spec)\.(jsx?|tsx?|mjs|cjs)\z", "pytest": r"^(test_.+\.py|.+_test\.py)\z"}
TEST_DIR = {"jest": "__tests__"}
RUST_TEST = r"#\s*\[\s*test\s*[(\]]"
JEST_CONFIGS = ("jest.config.js", "jest.config.ts", "jest.config.mjs", "jest.config.cjs", "jest.config.json")
# End of fixed values.

#: In the order of detection.
ANALYZERS = ("go", "jest", "pytest", "cargo")


def rows() -> list[tuple[str, str, str, str]]:
    """All rules as rows (analyzer, rule, match_kind, value)."""
    out = [(a, "full_run", "basename", v) for a, vs in FULL_RUN_NAMES.items() for v in vs]
    out += [(a, "full_run", "prefix_suffix", f"{p}*{s}") for a, vs in FULL_RUN_PREFIX_SUFFIX.items() for p, s in vs]
    out += [(a, "full_run", "parent_dir", f"{d}/{n}") for a, vs in FULL_RUN_PARENT.items() for d, ns in vs for n in ns]
    out += [(a, "tracked_ext", "ext", v) for a, vs in TRACKED_EXT.items() for v in vs]
    out += [(a, "ignorable", "suffix", v) for a, vs in UNTRACKED_SUFFIX.items() for v in vs]
    out += [(a, "skip_dir", "basename", v) for a, vs in SKIPPED_DIRS.items() for v in vs]
    out += [(a, "skip_dir", "suffix", v) for a, vs in SKIPPED_DIR_SUFFIX.items() for v in vs]
    out += [(a, "test_file", "regex", v) for a, v in TEST_FILE.items()]
    return out + [(a, "test_file", "part", v) for a, v in TEST_DIR.items()]


def table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), RULES)


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


def full_run(analyzer: str, path: Column) -> Column:
    """Whether a change of the file forbids narrowing."""
    name = paths.base(path)
    tests = [name.isin(*FULL_RUN_NAMES[analyzer])]
    tests += [F.startswith(name, F.lit(p)) & F.endswith(name, F.lit(s)) for p, s in FULL_RUN_PREFIX_SUFFIX.get(analyzer, ())]
    tests += [(paths.base(paths.parent(path)) == d) & name.isin(*ns) for d, ns in FULL_RUN_PARENT.get(analyzer, ())]
    return either(tests)


def tracked(analyzer: str, path: Column) -> Column:
    out = paths.ext(path).isin(*TRACKED_EXT[analyzer])
    for s in UNTRACKED_SUFFIX.get(analyzer, ()):
        out = out & ~F.endswith(path, F.lit(s))
    return out


def ignorable(analyzer: str, path: Column) -> Column:
    """Whether a file that belongs to no node can be left out of account."""
    return ~tracked(analyzer, path)


def test_file(analyzer: str, path: Column) -> Column:
    if analyzer not in TEST_FILE:  # crates are judged by their contents
        return F.lit(False)
    by_name = F.rlike(paths.base(path), F.lit(TEST_FILE[analyzer]))
    return by_name | F.array_contains(F.split(path, "/"), TEST_DIR[analyzer]) if analyzer in TEST_DIR else by_name


def skipped(analyzer: str, rel: Column) -> Column:
    """Whether some folder of a path relative to the tree's root is pruned."""
    parts = F.split(rel, "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    names = SKIPPED_DIRS[analyzer]
    hit = F.arrays_overlap(folders, F.array(*map(F.lit, names))) if names else F.lit(False)
    for suffix in map(F.lit, SKIPPED_DIR_SUFFIX.get(analyzer, ())):
        hit = hit | F.exists(folders, lambda d: F.endswith(d, suffix))  # noqa: B023
    return hit


def by_analyzer(analyzer: Column, f) -> Column:
    """One predicate over rows of several analyzers."""
    out = F.when(analyzer == ANALYZERS[0], f(ANALYZERS[0]))
    for a in ANALYZERS[1:]:
        out = out.when(analyzer == a, f(a))
    return F.coalesce(out, F.lit(False))
