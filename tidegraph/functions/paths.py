"""Path functions as columns; only dots in paths need Python."""

from __future__ import annotations

import posixpath

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def base(p: Column) -> Column:
    return F.element_at(F.split(p, "/"), -1)


def parent(p: Column) -> Column:
    """The folder; of a name without one "."; of a path in the root "/"."""
    cut = F.regexp_replace(p, r"/[^/]*\z", "")
    return F.when(~F.contains(p, F.lit("/")), F.lit(".")).when(cut == "", F.lit("/")).otherwise(cut)


def ext(p: Column) -> Column:
    """From the last dot of the base name on; empty without one."""
    return F.regexp_extract(p, r"(\.[^./]*)\z", 1)


def ancestors(p: Column) -> Column:
    """All folders above a path, the nearest first: /a/b/c gives [/a/b, /a, /], a/b/c gives [a/b, a, .]."""
    parts = F.split(p, "/")
    n = F.size(parts)
    cut = F.transform(F.sequence(F.lit(1), F.greatest(n - F.startswith(p, F.lit("/")).cast("int"), F.lit(1))), lambda i: F.array_join(F.slice(parts, 1, n - i), "/"))
    return F.transform(cut, lambda d: F.when(d == "", F.when(F.startswith(p, F.lit("/")), F.lit("/")).otherwise(F.lit("."))).otherwise(d))


def join(a: Column, b: Column) -> Column:
    return F.when(a.isin(".", ""), b).otherwise(F.concat_ws("/", F.regexp_replace(a, r"/\z", ""), b))


def relative_or_self(root: Column, p: Column) -> Column:
    """Relative to ``root`` if inside it, otherwise the path as it is."""
    return F.when(p == root, F.lit(".")).when(F.startswith(p, F.concat(root, F.lit("/"))), F.substr(p, F.length(root) + 2)).otherwise(p)


@F.pandas_udf(StringType())
def normalize(p: pd.Series) -> pd.Series:
    """Without empty parts, "." and ".." (Python, as the number of steps back has no bound)."""
    return p.map(lambda x: None if x is None else posixpath.normpath(x))


@F.pandas_udf(StringType())
def relative(p: pd.Series, root: pd.Series) -> pd.Series:
    """Relative to ``root``, with steps back where the path is outside it."""
    return pd.Series([None if a is None or b is None else posixpath.relpath(a, b) for a, b in zip(p, root, strict=True)], dtype=object)


def go_pattern(rel: Column) -> Column:
    """A folder relative to the workspace as a package pattern."""
    return F.when(rel == ".", F.lit("./...")).when(F.startswith(rel, F.lit("..")), F.concat(rel, F.lit("/..."))).otherwise(F.concat(F.lit("./"), rel, F.lit("/...")))


def quote(p: Column) -> Column:
    """Regex metacharacters behind a backslash."""
    return F.regexp_replace(p, r"([\\.+*?()|\[\]{}^$])", r"\\$1")


def real_target(package_id: Column, path: Column) -> Column:
    """The package that a test variant belongs to: the text in brackets without .test, else the package path."""
    inside = F.regexp_extract(package_id, r" \[(.*)\]\z", 1)
    return F.when(F.contains(package_id, F.lit(" [")), F.regexp_replace(inside, r"\.test\z", "")).otherwise(path)


def module_name(rel: Column) -> Column:
    """The dotted name of a Python file relative to its root; null for the root's own __init__.py."""
    bare = F.regexp_replace(F.regexp_replace(rel, r"(^|/)__init__\.py\z", ""), r"\.py\z", "")
    return F.nullif(F.array_join(F.filter(F.split(bare, "/"), lambda x: x != ""), "."), F.lit(""))


def package_of(module: Column, is_init: Column) -> Column:
    """The package that relative imports of a module start from; empty if none."""
    up = F.regexp_replace(module, r"\.[^.]*\z", "")
    return F.when(module.isNull(), F.lit("")).when(is_init, module).when(F.contains(module, F.lit(".")), up).otherwise(F.lit(""))
