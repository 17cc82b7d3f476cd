"""Exact dedup with an extendible-hash index on shared files.

A text's key is a 64-bit hash of its normalised bytes. The steps:

1. Every row's place, key and SHA-256 are written once and tallied with partial sums. Groups with more than 1/HOT of all rows (hence fewer than HOT of them, small enough
   to broadcast) send on only one row, with the group's count; so however many copies a text has, its owner gets it seldom.
2. Owner tasks process ranges of keys, the leading bits of the key, in key order. Each keeps an extendible-hash directory: a slot for every value of the next ``depth`` bits, several slots
   to a bucket. An overfull bucket splits by its next bit; where no slot is left to tell the halves apart, the directory doubles. Rows of one key are chained in their
   bucket and their bytes compared, so equal keys of different texts stay apart. Buckets whose keys have all passed are written as pages, and at the owner's end its directory,
   to a Parquet table in the shared folder, where Spark's commit protocol keeps the files of a lost or repeated task apart.
3. Look-ups, one of each distinct text, meet the index in key order: owner, slot, bucket, chain. Their results are joined to the rows, those of large groups by broadcast.

A directory has at most 2**MOST slots for each owner; a bucket that no longer splits grows, and the results stay the same.

Defined results: null is the empty text; empty texts form a group; of repeated doc_ids every row is counted and each gets
its group's result; a null doc_id stays (keep_id is the smallest doc_id that is not null, or null where there is none, and then the rows
of that group with a null doc_id count as kept); of rows that tie, ``copies`` keeps the first by place; texts of any length are compared whole, and an owner holds one bucket's; an empty
table gives no rows; other columns are neither read nor returned.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import FILE, ROW

SPACES = r"[\x20\x09-\x0D]+"
CAPACITY = 512
CAPACITY_BYTES = 4 << 20
OWNERS = 8
MOST = 20
#: Groups of at least this share of all rows are sent once; there are at most HOT of them (about 150 bytes each).
HOT = 50_000
PAGE = pa.schema(
    [("owner", pa.int32()), ("bucket", pa.int32()), ("depth", pa.int32()), ("first", pa.int64()), ("slots", pa.list_(pa.int32())), ("key", pa.list_(pa.int64()))]
    + [(name, pa.list_(pa.int64())) for name in ("keep_id", "keep_file", "keep_row", "size")]
    + [("text_sha256", pa.list_(pa.string())), ("text", pa.list_(pa.binary()))]
)
PAGE_SCHEMA = "owner int, bucket int, depth int, first long, slots array<int>, key array<long>, keep_id array<long>, keep_file array<long>, keep_row array<long>, size array<long>, text_sha256 array<string>, text array<binary>"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def key_of(norm: Column, key_bits: int) -> Column:
    """The key as a signed long. Fewer bits than 64 (for tests) make keys collide."""
    k = F.xxhash64(norm)
    return k if key_bits == 64 else F.shiftleft(F.shiftrightunsigned(k, 64 - key_bits), 64 - key_bits)


def sha_of(norm: Column) -> Column:
    return F.sha2(F.encode(norm, "UTF-8"), 256)


def in_order(key: Column) -> Column:
    """Signed longs in the order of the unsigned keys."""
    return key.bitwiseXOR(F.lit(-(1 << 63)))


def signed(key: int) -> int:
    return key - (1 << 64) if key >> 63 else key


def place_order(e: tuple) -> tuple:
    """(doc_id, file, row) so that null doc_ids come last."""
    return e[0] is None, e[0] or 0, e[1], e[2]


class Bucket:
    def __init__(self, number: int, depth: int) -> None:
        self.number, self.depth, self.bytes = number, depth, 0
        self.chains: dict[int, list[list]] = {}  # of a key: [place, size, sha, text] for each of its texts
        self.n = 0

    def add(self, key: int, entry: list) -> None:
        self.chains.setdefault(key, []).append(entry)
        self.n += 1
        self.bytes += len(entry[3])


class Directory:
    """One owner's directory and the buckets that are not yet written. An owner has the keys of one prefix of ``bits`` bits."""

    def __init__(self, owner: int, bits: int, capacity: int, capacity_bytes: int, most: int = MOST) -> None:
        self.owner, self.bits, self.capacity, self.capacity_bytes, self.most = owner, bits, capacity, capacity_bytes, most
        self.depth, self.slots, self.made = 0, [0], 1
        self.buckets = {0: Bucket(0, 0)}
        self.at = 0  # the bucket of the last key

    def slot(self, key: int) -> int:
        return key >> (64 - self.bits - self.depth) & (1 << self.depth) - 1 if self.depth else 0

    def put(self, key: int, place: tuple, size: int, sha: str, text: bytes) -> Iterator[dict]:
        """Add a text, or a copy of one; pages of the buckets that are complete, as keys come in order."""
        at = self.slots[self.slot(key)]
        if at != self.at:
            for number in sorted(n for n in self.buckets if n != at and self.last_key(self.buckets[n]) < key):
                yield from self.page(self.buckets.pop(number))
            self.at = at
        bucket = self.buckets[at]
        for e in bucket.chains.get(key, ()):
            if e[3] == text:
                e[0] = min(e[0], place, key=place_order)
                e[1] += size
                return
        bucket.add(key, [place, size, sha, text])
        self.settle(bucket)

    def settle(self, bucket: Bucket) -> None:
        todo = [bucket]
        while todo:
            b = todo.pop()
            if (b.n > self.capacity or b.bytes > self.capacity_bytes) and len(b.chains) > 1 and b.depth < self.most and b.depth + self.bits < 64:
                todo += self.split(b)

    def split(self, bucket: Bucket) -> list[Bucket]:
        """Part a bucket by its next bit; the directory doubles if its slots are too few to tell the halves apart."""
        if bucket.depth == self.depth:
            self.slots = [s for s in self.slots for _ in (0, 1)]
            self.depth += 1
        low, high = Bucket(bucket.number, bucket.depth + 1), Bucket(self.made, bucket.depth + 1)
        self.made += 1
        bit = 64 - self.bits - low.depth
        for key, chain in bucket.chains.items():
            for e in chain:
                (high if key >> bit & 1 else low).add(key, e)
        some = self.slot(next(iter(bucket.chains)))
        width = 1 << self.depth - bucket.depth  # slots that point to the bucket
        first = some // width * width
        self.slots[first + width // 2 : first + width] = [high.number] * (width // 2)
        self.buckets[low.number], self.buckets[high.number] = low, high
        return [low, high]

    def first_key(self, bucket: Bucket) -> int:
        """The smallest key that belongs to the bucket."""
        at = self.slots.index(bucket.number)
        return (self.owner << 64 - self.bits if self.bits else 0) | (at << 64 - self.bits - self.depth)

    def last_key(self, bucket: Bucket) -> int:
        return self.first_key(bucket) + (1 << 64 - self.bits - bucket.depth) - 1

    def page(self, bucket: Bucket) -> Iterator[dict]:
        found = [(signed(k), *e) for k in sorted(bucket.chains) for e in bucket.chains[k]]
        if found:
            key, place, size, sha, text = zip(*found, strict=True)
            doc, file, row = zip(*place, strict=True)
            yield {"owner": self.owner, "bucket": bucket.number, "depth": bucket.depth, "first": signed(self.first_key(bucket)), "slots": None, "key": key, "keep_id": doc, "keep_file": file, "keep_row": row, "size": size, "text_sha256": sha, "text": text}

    def end(self) -> Iterator[dict]:
        """The last pages, and the directory as a row with no bucket."""
        for b in self.buckets.values():
            yield from self.page(b)
        yield {"owner": self.owner, "bucket": None, "depth": self.depth, "first": signed(self.owner << 64 - self.bits if self.bits else 0), "slots": self.slots}


def combined(norm: DataFrame, held_bytes: int = 32 << 20, piece_bytes: int = 1 << 20) -> DataFrame:
    """Rows ``(key, norm, doc, file, row, size)``: equal texts of a task as one row. A task holds at most ``held_bytes`` of text, then passes on what it has in batches of about ``piece_bytes``."""
    kinds = [("key", pa.int64()), ("norm", pa.string()), ("doc", pa.int64()), ("file", pa.int64()), ("row", pa.int64()), ("size", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        bytes_ = 0

        def out() -> Iterator[pa.RecordBatch]:
            rows, n = [], 0
            for norm, e in held.items():
                rows.append((e[0], norm, *e[1], e[2]))
                n += len(norm) + 200
                if n > piece_bytes:
                    yield batch(rows)
                    rows, n = [], 0
            if rows:
                yield batch(rows)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(kinds)], [name for name, _ in kinds])

        for b in batches:
            for key, norm, size, *place in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
                e = held.get(norm)
                if e is None:
                    held[norm] = [key, tuple(place), size]
                    bytes_ += len(norm) + 200
                    if bytes_ > held_bytes:
                        yield from out()
                        held, bytes_ = {}, 0
                else:
                    e[1] = min(e[1], tuple(place), key=place_order)
                    e[2] += size
        yield from out()
        held.clear()
        common.trim()

    return norm.select("key", "norm", "size", "doc_id", FILE, ROW).mapInArrow(run, "key long, norm string, doc long, file long, row long, size long")


class Index:
    """The index of ``docs(doc_id, text)`` in the shared folder, with the tables that it was made from."""

    def __init__(self, docs: DataFrame, *, capacity: int = CAPACITY, capacity_bytes: int = CAPACITY_BYTES, key_bits: int = 64, hot: int = HOT) -> None:
        spark = self.spark = docs.sparkSession
        self.n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.bits = (OWNERS * self.n - 1).bit_length()  # several owners a partition, so that they spread evenly
        self.paths: list[str] = []
        d = (docs if FILE in docs.columns else common.placed(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), FILE, ROW, normalised(F.col("text")).alias("norm"))
        d = d.withColumn("key", key_of(F.col("norm"), key_bits))
        self.keys = self.table(d.select("doc_id", FILE, ROW, "key", sha_of(F.col("norm")).alias("text_sha256")), "keys")
        tally = self.keys.groupBy("key", "text_sha256").agg(F.count("*").alias("size"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", FILE, ROW)).alias("first"))
        self.tally = self.table(tally.select("key", "text_sha256", "size", F.col(f"first.{FILE}").alias("keep_file"), F.col(f"first.{ROW}").alias("keep_row")), "tally")
        self.large = max(16, self.keys.count() // hot + 1)
        large = F.broadcast(self.tally.where(F.col("size") >= self.large).withColumnsRenamed({"key": "k", "text_sha256": "sha"}))
        d = d.join(large, (F.col("key") == F.col("k")) & (sha_of(F.col("norm")) == F.col("sha")), "left")
        d = d.where((F.col("k").isNull()) | (F.col(FILE) == F.col("keep_file")) & (F.col(ROW) == F.col("keep_row"))).withColumn("size", F.coalesce("size", F.lit(1)).cast("long"))
        owned = combined(d).withColumn("owner", self.owner()).repartition(self.n, "owner").withColumn("order", in_order(F.col("key"))).sortWithinPartitions("owner", "order")
        bits = self.bits

        def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            directory = None
            out = lambda p: pa.RecordBatch.from_pylist([p], schema=PAGE)
            for b in batches:
                for owner, key, doc, file, row, size, sha, text in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                    if directory is None or owner != directory.owner:
                        yield from map(out, directory.end() if directory else ())
                        directory = Directory(owner, bits, capacity, capacity_bytes)
                    yield from map(out, directory.put(key % (1 << 64), (doc, file, row), size, sha, text))
            yield from map(out, directory.end() if directory else ())

        pages = owned.select("owner", "key", "doc", "file", "row", "size", sha_of(F.col("norm")), F.encode("norm", "UTF-8")).mapInArrow(own, PAGE_SCHEMA)
        self.pages = self.table(pages, "dedup-index", 256)

    def table(self, df: DataFrame, name: str, rows: int = common.BATCH) -> DataFrame:
        self.paths.append(common.write(df, name, rows))
        return common.reread(df, self.paths[-1])

    def owner(self) -> Column:
        return F.shiftrightunsigned("key", 64 - self.bits).cast("int")

    def find(self, texts: DataFrame) -> DataFrame:
        """``(key, text_sha256, keep_id, keep_file, keep_row, group_size)`` for those of ``texts(key, text_sha256)`` that the index has, by owner, directory, bucket and chain."""
        asked = texts.select(self.owner().alias("owner"), in_order(F.col("key")).alias("order"), F.lit(2).alias("kind"), F.col("key").alias("asked"), F.col("text_sha256").alias("sha"))
        kind = F.when(F.col("bucket").isNull(), 0).otherwise(1)
        index = self.pages.select("owner", in_order(F.col("first")).alias("order"), kind.alias("kind"), "bucket", "depth", "slots", "key", "keep_id", "keep_file", "keep_row", "size", "text_sha256")
        rows = asked.unionByName(index, allowMissingColumns=True).repartition(self.n, "owner").sortWithinPartitions("owner", "order", "kind")
        bits = self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            slots, depth, bucket, chains = [], 0, None, {}
            for b in batches:
                c = {name: b.column(i) for i, name in enumerate(b.schema.names)}
                out = []
                sha, asked = c["sha"].to_pylist(), c["asked"].to_pylist()
                for i, kind in enumerate(c["kind"].to_pylist()):
                    if kind == 0:
                        slots, depth, bucket = c["slots"][i].as_py(), c["depth"][i].as_py(), None
                    elif kind == 1:
                        bucket, chains = c["bucket"][i].as_py(), {}
                        for key, *e in zip(*(c[x][i].as_py() for x in ("key", "text_sha256", "keep_id", "keep_file", "keep_row", "size")), strict=True):
                            chains.setdefault(key, []).append(e)
                    else:
                        key = asked[i] % (1 << 64)
                        if slots[key >> (64 - bits - depth) & (1 << depth) - 1] == bucket:
                            out += [(asked[i], *e) for e in chains.get(asked[i], ()) if e[0] == sha[i]]
                kinds = [pa.int64(), pa.string(), *[pa.int64()] * 4]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["key", "text_sha256", "keep_id", "keep_file", "keep_row", "group_size"])

        return rows.mapInArrow(run, "key long, text_sha256 string, keep_id long, keep_file long, keep_row long, group_size long")

    def rows(self) -> DataFrame:
        """``(doc_id, FILE, ROW, text_sha256, keep_id, keep_file, keep_row, group_size)`` for every row of the table."""
        found = self.table(self.find(self.tally), "found")
        large = F.broadcast(found.where(F.col("group_size") >= self.large))
        key = ["key", "text_sha256"]
        hot = self.keys.join(large, key)
        rest = self.keys.join(large.select(*key), key, "left_anti").join(found.where(F.col("group_size") < self.large), key)
        return hot.unionByName(rest).drop("key")

    def drop(self) -> None:
        for p in self.paths:
            common.drop(self.spark, p)


def exact_dedup(docs: DataFrame, **options) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)`` for every row of ``docs(doc_id, text)``."""
    index = Index(docs, **options)
    out = common.stored(index.rows().select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"), "copies")
    index.drop()
    return out


def without_copies(docs: DataFrame) -> DataFrame:
    """One row of every group of equal texts: that of the smallest doc_id, the first by place of several."""
    placed = common.placed(docs)
    index = Index(placed)
    gone = common.stored(index.rows().where(f"{FILE} <> keep_file OR {ROW} <> keep_row").select(FILE, ROW), "gone")
    index.drop()
    return common.without(placed, gone)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm)
"""
