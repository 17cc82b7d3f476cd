"""File trees as tables."""

from __future__ import annotations

from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, rules


def local(path: Column) -> Column:
    """A file: URI as a plain path; other URIs stay."""
    return F.regexp_replace(path, r"^file:/+", "/")


def described(df: DataFrame) -> DataFrame:
    """``schema.FILES`` from (project, path, content)."""
    p = F.col("path")
    return df.select("project", "path", paths.parent(p).alias("dir"), paths.base(p).alias("base"), paths.ext(p).alias("ext"), F.col("content").cast("binary").alias("content"))


def read_tree(spark: SparkSession, root: str, pattern: str | None = None) -> DataFrame:
    """All files below ``root``; the project is the root. ``content`` is only read by queries that use it."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    loaded = reader.load(root)
    read = loaded.select(local(F.col("path")).alias("path"), "content")
    listed = [(unquote(p),) for p in loaded.inputFiles()]  # Spark lists on the driver anyway, but leaves empty files out when it reads
    names = spark.createDataFrame(listed, "path string").select(local(F.col("path")).alias("path"))
    df = names.join(read, "path", "left").withColumn("content", F.coalesce("content", F.lit(b"")))
    return described(df.withColumn("project", F.lit(root.rstrip("/"))))


def read_trees(spark: SparkSession, roots: list[str]) -> DataFrame:
    out = read_tree(spark, roots[0])
    for r in roots[1:]:
        out = out.unionByName(read_tree(spark, r))
    return out


def sources(files: DataFrame, analyzer: str) -> DataFrame:
    """The files that an analyzer tracks, without those below its skipped folders. Both tests need the path only, so content is read for the rest alone."""
    rel = paths.relative_or_self(F.col("project"), F.col("path"))
    return files.where(rules.tracked(analyzer, F.col("path")) & ~rules.skipped(analyzer, rel))


def has_token(files: DataFrame, name: str, token: str) -> DataFrame:
    """``(project, found)``: whether the project's own file ``name`` contains ``token``; false where it is missing."""
    hit = files.where((F.col("dir") == F.col("project")) & (F.col("base") == name)).select("project", F.contains(F.col("content").cast("string"), F.lit(token)).alias("hit"))
    return files.select("project").distinct().join(hit, "project", "left").groupBy("project").agg(F.coalesce(F.bool_or("hit"), F.lit(False)).alias("found"))
