"""Helpers that several operators share: tables in the shared folder, places of rows, Arrow mapping, words and shingles, components."""

from __future__ import annotations

import ctypes
import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import work
from ..work import drop, work_path

#: Words of near-duplicate operators: maximal runs of characters that are not white space, in lower case.
WORD = re.compile(r"\S+")
SHINGLE_WORDS = 5
THRESHOLD = 0.8
#: Rows of texts that Spark sends a Python worker at once.
BATCH, BATCH_KEY = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch | None]], schema, rows: int = 1000) -> DataFrame:
    """``mapInArrow`` in slices of at most ``rows`` rows. ``make`` runs once a task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = make()
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                out = f(batch.slice(at, rows))
                if out is not None and out.num_rows:
                    yield out
        del f
        trim()

    return df.mapInArrow(run, schema)


def trim() -> None:
    """Give freed memory back to the system, as workers live on between tasks and stages."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # other C libraries have no such call
        ctypes.CDLL("libc.so.6").malloc_trim(0)


@contextmanager
def batch_rows(spark: SparkSession, rows: int = BATCH):
    """Within it, jobs send Python at most ``rows`` rows at once (Spark's default is tens of megabytes of text); then the session is as it was."""
    before = spark.conf.get(BATCH_KEY, None)
    spark.conf.set(BATCH_KEY, str(min(rows, int(before)) if before and int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(BATCH_KEY, before) if before is not None else spark.conf.unset(BATCH_KEY)


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy in the shared folder instead of the lineage."""
    with batch_rows(df.sparkSession):
        return work.checkpoint(df)


def stored(df: DataFrame, name: str, rows: int = BATCH) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back."""
    return reread(df, write(df, name, rows))


def write(df: DataFrame, name: str, rows: int = BATCH) -> str:
    """The path of ``df`` as a Parquet table in the shared folder."""
    path = work_path(df.sparkSession, name)
    with batch_rows(df.sparkSession, rows):
        df.write.option("compression", "zstd").parquet(path)
    return path


def reread(df: DataFrame, path: str) -> DataFrame:
    return df.sparkSession.read.schema(df.schema).parquet(path)


FILE, ROW = "tg__file", "tg__row"


def placed(docs: DataFrame) -> DataFrame:
    """``docs`` with the place of each row, FILE (64 bits of its path's hash) and ROW, which stays the same whenever it is read.

    Rows of a plain scan of Parquet files have one; other DataFrames are copied to the shared folder first.
    """
    try:
        d = docs.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))
        d.schema  # noqa: B018
        return d
    except AnalysisException:
        d = stored(docs, "rows")
        return d.select("*", F.xxhash64("_metadata.file_path").alias(FILE), F.col("_metadata.row_index").alias(ROW))


def small(df: DataFrame, limit: int) -> DataFrame:
    """``df`` to be broadcast if it is counted to have at most ``limit`` rows, else as it is. Give it what a checkpoint holds."""
    return F.broadcast(df) if df.count() <= limit else df


def without(docs: DataFrame, places: DataFrame, limit: int = 500_000) -> DataFrame:
    """The ``placed`` rows ``docs`` without those at ``places(FILE, ROW)``; up to ``limit`` of these (16 bytes each) are broadcast, more are joined by a shuffle."""
    gone = checkpoint(places.select(FILE, ROW))
    return docs.join(small(gone, limit), [FILE, ROW], "left_anti").drop(FILE, ROW)


def texts(column: pa.Array) -> list[str]:
    """A text column as strings, null as the empty string."""
    return [x or "" for x in column.to_pylist()]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


class Hashes(dict):
    """64-bit hashes of words, computed when first asked for."""

    def __missing__(self, word: str) -> int:
        import xxhash

        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def hash_words(ws: list[str], seen: Hashes) -> np.ndarray:
    """A 64-bit hash of every word; ``seen`` keeps those of earlier words and is emptied when it is large."""
    if len(seen) > 300_000:
        seen.clear()
    return np.fromiter(map(seen.__getitem__, ws), np.uint64, len(ws))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(ws: list[str], seen: Hashes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of ``n`` words. A text of fewer words is one shingle; none without words."""
    return np.unique(shingle_sequence(ws, seen, n))


def shingle_sequence(ws: list[str], seen: Hashes, n: int = SHINGLE_WORDS) -> np.ndarray:
    """The shingles' hashes in the order of the text."""
    if not ws:
        return np.empty(0, np.uint64)
    h = hash_words(ws, seen)
    n = min(n, len(ws))
    out = np.full(len(ws) - n + 1, n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : len(h) - n + 1 + i])
    return out


def components(edges: DataFrame, rounds: int = 60, limit: int = 200_000) -> DataFrame:
    """Connected components of ``edges(u, v)`` (longs): rows ``(node, root)``, root the smallest node.

    Alternating large-star and small-star steps; each is one aggregation with partial sums and one join, so that neither a component nor the
    neighbours of a node are gathered in a row. Up to ``limit`` edges the nodes' minima (16 bytes each) are broadcast to them. Beyond it they are
    checkpointed first, so that both sides of the join come straight from a shuffle and adaptive execution can split a node of many edges.
    Lineage is cut each round.
    """
    e = checkpoint(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    n = e.count()

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        joined = both.join(F.broadcast(least) if n <= limit else checkpoint(least), "u")
        if large:
            return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        kept = joined.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return kept.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()

    sign = None
    for _ in range(rounds if n else 0):
        e = checkpoint(star(star(e, True), False))
        now = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == sign:
            break
        sign, n = now, now.n
    else:
        if n:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
