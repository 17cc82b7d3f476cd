"""What kind of project a tree is, from its files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules

PACKAGE = "dependencies map<string,string>, devDependencies map<string,string>, jest string"


def facts(files: DataFrame) -> DataFrame:
    """``(project, go, jest, pytest, cargo)``: whether each analyzer's conditions hold for the files in the project's own folder."""
    top = files.where(F.col("dir") == F.col("project")).select("project", "base", F.col("content").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))

    def there(*names: str) -> Column:
        return F.coalesce(F.bool_or(F.col("base").isin(*names)), F.lit(False))

    def holds(name: str, token: str) -> Column:
        return F.coalesce(F.bool_or((F.col("base") == name) & F.contains(text, F.lit(token))), F.lit(False))

    package = F.from_json(text, PACKAGE)
    jest_package = F.coalesce(F.bool_or((F.col("base") == "package.json") & (package["jest"].isNotNull() | F.coalesce(F.map_contains_key(package["dependencies"], F.lit("jest")), F.lit(False)) | F.coalesce(F.map_contains_key(package["devDependencies"], F.lit("jest")), F.lit(False)))), F.lit(False))
    pytest = there("pytest.ini", "conftest.py") | holds("tox.ini", "pytest") | holds("setup.cfg", "[tool:pytest]") | holds("pyproject.toml", "[tool.pytest.ini_options]")
    for name in ("pyproject.toml", "requirements.txt", "requirements-dev.txt", "requirements-test.txt", "Pipfile"):
        pytest = pytest | holds(name, "pytest")
    return top.groupBy("project").agg(there("go.mod", "go.work").alias("go"), (there("package.json") & (jest_package | there(*rules.JEST_CONFIGS))).alias("jest"), pytest.alias("pytest"), there("Cargo.toml").alias("cargo"))


def detected(facts_: DataFrame) -> DataFrame:
    """``(project, analyzer)``: the first in the fixed order that holds, null if none."""
    out = F.when(F.col("go"), "go")
    for a in rules.ANALYZERS[1:]:
        out = out.when(F.col(a), a)
    return facts_.select("project", out.alias("analyzer"))
