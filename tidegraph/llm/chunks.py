"""Chunks of rows that ask owners of keys and read the answers: blobs go to a key's bucket, answers lie in a folder by chunk."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .common import FILE, ROW

CHUNK_ROWS = 8192


def chunked(docs: DataFrame) -> DataFrame:
    """``(chunk, row, doc_id, text)``: rows by a place that stays the same whenever they are read."""
    d = common.placed(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    chunk = F.abs(F.xxhash64(FILE, F.floor(F.col(ROW) / CHUNK_ROWS)))
    return d.select(F.greatest(chunk, F.lit(0)).alias("chunk"), (F.col(ROW) % CHUNK_ROWS).cast("int").alias("row"), "doc_id", "text")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple[int, bytes]]]:
    """The (chunk, blob) of each bucket, from rows in the order of buckets."""
    now, held = None, []
    for b in batches:
        for bucket, chunk, blob in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            if bucket != now:
                if held:
                    yield held
                now, held = bucket, []
            held.append((chunk, blob))
    if held:
        yield held


def write_by_chunk(df: DataFrame, path: str, n: int, parts: int) -> str:
    """A folder of at most ``parts`` parts, each a file in the order of chunks with small row groups, of which a reader opens those of its chunk."""
    df = df.withColumn("part", F.pmod("chunk", F.lit(parts)).cast("int")).repartition(n, "part").sortWithinPartitions("part", "chunk")
    df.write.partitionBy("part").option("parquet.block.size", 1 << 20).parquet(path)
    return path


class ChunkBlobs:
    """Reads a folder of ``write_by_chunk`` with so many parts."""

    def __init__(self, folder: str, parts: int) -> None:
        self.fs, self.root = pafs.FileSystem.from_uri(folder)
        self.parts = parts
        if self.fs.get_file_info(self.root).type != pafs.FileType.Directory:
            raise FileNotFoundError(f"{folder} can't be seen here; spark.checkpoint.dir has to be shared by all executors")

    def blobs(self, chunk: int) -> list[bytes]:
        files = self.fs.get_file_info(pafs.FileSelector(f"{self.root}/part={chunk % self.parts}", allow_not_found=True))  # a part without answers has no folder
        names = [f.path for f in files if f.base_name.endswith(".parquet")]
        return [x for f in names for x in pq.read_table(f, filesystem=self.fs, columns=["blob"], filters=[("chunk", "=", chunk)]).column(0).to_pylist()]
