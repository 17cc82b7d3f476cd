"""Session settings, the shared work folder and lineage cuts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side may be broadcast; keys are short strings, so this is some tens of MB at most.
BROADCAST_ROWS = 200_000


def session(name: str = "tidegraph", **conf: str) -> SparkSession:
    """A session with the settings that the engine is written for; ``conf`` adds to or replaces them."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def work_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``. Where that is unset, a local master gets a folder of its own; a cluster has to name one."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not at:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidegraph-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(at)
    return at.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{work_dir(spark)}/tidegraph-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder of our own below the shared one."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def clear(spark: SparkSession) -> None:
    """Delete everything that this application put below the shared folder with ``work_path``: results that are still to be read included."""
    drop(spark, f"{work_dir(spark)}/tidegraph-{spark.sparkContext.applicationId}")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder, which outlives executors."""
    work_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, counted to have ``rows`` rows, marked for broadcast if these are at most ``limit``."""
    return F.broadcast(df) if rows <= limit else df
