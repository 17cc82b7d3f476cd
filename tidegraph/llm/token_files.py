"""Token ids in binary files of patched frame-of-reference blocks.

A shard holds whole documents in ascending doc_id order, at most ``shard_ids`` ids (or one longer document):

    magic (8 bytes), counts of documents, ids, ids a block and blocks (four u64)
    doc_id of each document (i64), their null marks (u8), end of each document in ids (u64)
    byte offset of each block and of the last one's end (u64)
    blocks: minimum (u32), width (u8), number of exceptions (u8), two zero bytes,
            the low ``width`` bits of value - minimum, packed in 64-bit words,
            positions of the exceptions (u8 each), their bits above the width (u32 each)

The width is the one that ``percentile`` of the block's values fit in; the rest are the exceptions. Numbers are little-endian. The index of
block starts lets ``Shard.ids`` decode only the blocks that a document lies in.

Tasks write to the shared folder under names of their own attempt, and the manifest names the files of those that finished, so that a lost or repeated task changes nothing; nothing is
renamed or replaced. Folders may be on any file system that pyarrow opens by URI (file, hdfs, s3, gs, abfs).

Defined results: null and empty texts are the end id alone; special strings in texts count as the library's default has it; rows of one
doc_id follow one another, by text; null doc_ids come first; an empty table writes no shard; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .token_counts import PLAIN, plain_pieces

MAGIC = b"TGPFOR1\0"
BLOCK = 128
PERCENTILE = 0.98
#: Words whose ids a task keeps in each of two generations.
KEPT = 250_000


class WordEncoder:
    """Ids of a word-end BPE file as the tokenizers library gives them; those of words it has met are kept."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.lib = Tokenizer.from_file(path)
        self.pattern = plain_pieces(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"], spaces=False)
        self.specials = [t["content"] for t in spec["added_tokens"]]
        end = spec["model"]["end_of_word_suffix"]
        self.final = np.zeros(max(spec["model"]["vocab"].values()) + 1, bool)
        self.final[[i for v, i in spec["model"]["vocab"].items() if v.endswith(end)]] = True
        apart = [chr(c) for c in range(33, 0x180) if PLAIN.match(chr(c)) and not chr(c).isalpha()]
        self.marks = [c for c in apart if self.pattern.fullmatch(c)]
        self.side_by_side = re.compile("[" + "".join(re.escape(c) for c in apart if not c.isnumeric()) + "]{2}")
        self.words: dict[str, bytes] = {"": b""}
        self.old_words: dict[str, bytes] = {}

    def spaced(self, text: str) -> str:
        """A plain text in lower case with white space between all its words. Marks that stand alone need no pattern to be set apart."""
        text = text.lower()
        if "'" in text or self.side_by_side.search(text):
            return " ".join(self.pattern.findall(text))
        for mark in self.marks:
            if mark in text:
                text = text.replace(mark, f" {mark} ")
        return text

    def learn(self, new: list[str]) -> None:
        """The library encodes the new words in a row; each ends with its one word-end token."""
        for at in range(0, len(new), 20_000):
            part = new[at : at + 20_000]
            ids = np.array(self.lib.encode(" ".join(part), add_special_tokens=False).ids, "<u4")
            cuts = [0, *(4 * np.flatnonzero(self.final[ids]) + 4).tolist()]
            if len(cuts) != len(part) + 1:
                raise ValueError("words and word-end tokens differ in number")
            raw = ids.tobytes()
            for w, a, b in zip(part, cuts, cuts[1:], strict=False):
                self.words[w] = raw[a:b]

    def encode_batch(self, texts: list[str]) -> list[np.ndarray]:
        """Plain texts by their words, each distinct one of the batch looked up once; other texts whole by the library."""
        if len(self.words) > KEPT:
            self.old_words, self.words = self.words, {"": b""}
        words, old = self.words, self.old_words
        plain = [bool(PLAIN.match(t)) and not any(s in t for s in self.specials) for t in texts]
        split = pc.ascii_split_whitespace(pa.array([self.spaced(t) for t, p in zip(texts, plain, strict=True) if p], pa.large_string()))
        coded = split.flatten().dictionary_encode()
        distinct, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        ids = list(map(words.get, distinct))
        unknown = [w for w, x in zip(distinct, ids, strict=True) if x is None]
        words.update({w: old[w] for w in unknown if w in old})
        self.learn([w for w in unknown if w not in words])
        ids = [words[w] if x is None else x for w, x in zip(distinct, ids, strict=True)]
        flat = np.frombuffer(b"".join(ids), "<u4")
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, size = (np.cumsum(size) - size)[codes], size[codes]
        before = np.concatenate([[0], np.cumsum(size)])
        flat = flat[np.repeat(start - before[:-1], size) + np.arange(before[-1])]
        cuts = before[split.offsets.to_numpy()]
        other = iter(self.lib.encode_batch([t for t, p in zip(texts, plain, strict=True) if not p], add_special_tokens=False))
        own = iter(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True))
        return [flat[slice(*next(own))] if p else np.array(next(other).ids, "<u4") for p in plain]


@cache
def kept_encoder(path: str) -> WordEncoder:
    """One encoder a worker process: its words serve the tasks that follow."""
    return WordEncoder(path)


# -- blocks


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[bytes, np.ndarray]:
    """The blocks' bytes and sizes. ``ids`` fills whole blocks but for the last, which repeats its last id."""
    if not len(ids):
        return b"", np.empty(0, np.int64)
    n = -(-len(ids) // BLOCK)
    full = np.empty(n * BLOCK, np.uint32)
    full[: len(ids)], full[len(ids) :] = ids, ids[-1]
    full = full.reshape(n, BLOCK)
    low = full.min(1)
    delta = full - low[:, None]
    bits = np.frexp(delta.astype(np.float64))[1].astype(np.uint8)
    at = min(BLOCK - 1, int(np.ceil(percentile * BLOCK)) - 1)
    width = np.partition(bits, at, axis=1)[:, at]
    over = bits > width[:, None]
    n_over = over.sum(1)
    sizes = 8 + 16 * width.astype(np.int64) + 5 * n_over
    starts = np.concatenate([[0], np.cumsum(sizes)])
    out = np.zeros(starts[-1], np.uint8)
    head = np.zeros((n, 8), np.uint8)
    head[:, :4] = low.astype("<u4").view(np.uint8).reshape(n, 4)
    head[:, 4], head[:, 5] = width, n_over
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        block = np.empty((len(rows), 8 + 16 * w), np.uint8)
        block[:, :8] = head[rows]
        if w:
            values = np.ascontiguousarray(delta[rows].T).astype(np.uint64) & np.uint64((1 << w) - 1)
            words = np.zeros((2 * w, len(rows)), np.uint64)
            for j in range(BLOCK):
                k, s = divmod(j * w, 64)
                words[k] |= values[j] << np.uint64(s)
                if s + w > 64:
                    words[k + 1] |= values[j] >> np.uint64(64 - s)
            block[:, 8:] = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(rows), 16 * w)
        out[starts[rows][:, None] + np.arange(block.shape[1])] = block
    rows, cols = np.nonzero(over)
    if len(rows):
        rank = np.arange(len(rows)) - (np.cumsum(n_over) - n_over)[rows]
        base = starts[rows] + 8 + 16 * width[rows].astype(np.int64)
        out[base + rank] = cols
        high = (delta[rows, cols].astype(np.uint64) >> width[rows].astype(np.uint64)).astype("<u4").view(np.uint8).reshape(-1, 4)
        out[(base + n_over[rows] + 4 * rank)[:, None] + np.arange(4)] = high
    return out.tobytes(), sizes


def unpack_blocks(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The ids of the blocks that begin at ``starts`` in the bytes ``data``."""
    n = len(starts)
    head = data[starts[:, None] + np.arange(8)]
    low = np.ascontiguousarray(head[:, :4]).view("<u4").ravel()
    width, n_over = head[:, 4], head[:, 5].astype(np.int64)
    out = np.empty((n, BLOCK), np.uint64)
    for w in np.unique(width).tolist():
        rows = np.flatnonzero(width == w)
        if not w:
            out[rows] = 0
            continue
        raw = data[(starts[rows] + 8)[:, None] + np.arange(16 * w)]
        words = np.ascontiguousarray(np.ascontiguousarray(raw).view("<u8").T)
        values = np.empty((BLOCK, len(rows)), np.uint64)
        for j in range(BLOCK):
            k, s = divmod(j * w, 64)
            v = words[k] >> np.uint64(s)
            if s + w > 64:
                v = v | words[k + 1] << np.uint64(64 - s)
            values[j] = v & np.uint64((1 << w) - 1)
        out[rows] = values.T
    if n_over.sum():
        rows = np.repeat(np.arange(n), n_over)
        rank = np.arange(len(rows)) - (np.cumsum(n_over) - n_over)[rows]
        base = starts[rows] + 8 + 16 * width[rows].astype(np.int64)
        high = np.ascontiguousarray(data[(base + n_over[rows] + 4 * rank)[:, None] + np.arange(4)]).view("<u4").ravel()
        out[rows, data[base + rank]] |= high.astype(np.uint64) << width[rows].astype(np.uint64)
    return (out + low[:, None]).astype(np.uint32).ravel()


def shard_bytes(doc_ids: list[int | None], arrays: list[np.ndarray], percentile: float = PERCENTILE) -> bytes:
    ends = np.cumsum([len(a) for a in arrays]).astype("<u8")
    total = int(ends[-1]) if len(ends) else 0
    parts, sizes, held, have = [], [], [], 0
    step = 8192 * BLOCK
    for a in [*arrays, None]:
        if a is not None:
            held.append(a)
            have += len(a)
        while have >= step or a is None and have:
            ids = np.concatenate(held)
            data, size = pack_blocks(ids[:step], percentile)
            parts.append(data)
            sizes.append(size)
            held, have = [ids[step:]], max(0, len(ids) - step)
    starts = np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else [])]).astype("<u8")
    known = [0 if d is None else d for d in doc_ids]
    head = MAGIC + struct.pack("<4Q", len(doc_ids), total, BLOCK, len(starts) - 1)
    return b"".join([head, np.array(known, "<i8").tobytes(), bytes(d is None for d in doc_ids), ends.tobytes(), starts.tobytes(), *parts])


class Shard:
    """A shard's bytes, opened."""

    def __init__(self, data: bytes) -> None:
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        docs, self.n_ids, self.block, blocks = struct.unpack_from("<4Q", data, 8)
        at = 40
        ids = np.frombuffer(data, "<i8", docs, at).tolist()
        null = data[at + 8 * docs : at + 9 * docs]
        self.doc_ids = [None if null[i] else d for i, d in enumerate(ids)]
        at += 9 * docs
        self.ends = np.frombuffer(data, "<u8", docs, at).astype(np.int64)
        self.starts = np.frombuffer(data, "<u8", blocks + 1, at + 8 * docs).astype(np.int64)
        self.data = np.frombuffer(data, np.uint8, offset=at + 8 * docs + 8 * (blocks + 1))

    def slice(self, lo: int, hi: int) -> np.ndarray:
        """The ids from ``lo`` to before ``hi``, from the blocks that hold them."""
        if hi <= lo:
            return np.empty(0, np.uint32)
        a, b = lo // self.block, -(-hi // self.block)
        return unpack_blocks(self.data, self.starts[a:b])[lo - a * self.block : hi - a * self.block]

    def ids(self, k: int) -> np.ndarray:
        """The ids of the shard's document number ``k``."""
        return self.slice(int(self.ends[k - 1]) if k else 0, int(self.ends[k]))


# -- folders of shards

MANIFEST = "part int, seq int, path string, n_docs long, n_ids long, n_bytes long"


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None = None, shard_ids: int = 16 << 20) -> DataFrame:
    """Encode ``docs(doc_id, text)`` into shards below ``folder`` in ascending doc_id order; the manifest, a row a shard."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.selectExpr("cast(doc_id AS long) doc_id", "coalesce(text, '') text")
    ordered = ordered.repartitionByRange(n, "doc_id", F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")  # a doc_id of many rows is parted, too

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, attempt = context.partitionId(), context.taskAttemptId()
        encoder = kept_encoder(tokenizer)
        fs, root = pafs.FileSystem.from_uri(folder)
        doc_ids, arrays, have, seq = [], [], 0, 0

        def flush() -> pa.RecordBatch:
            nonlocal doc_ids, arrays, have, seq
            data = shard_bytes(doc_ids, arrays)
            path = f"{root}/{part:08d}-{seq:05d}-{attempt}.tgids"
            fs.create_dir(root, recursive=True)
            with fs.open_output_stream(path) as f:
                f.write(data)
            row = pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "path": path, "n_docs": len(doc_ids), "n_ids": have, "n_bytes": len(data)}], schema=pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))
            doc_ids, arrays, have, seq = [], [], 0, seq + 1
            return row

        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part_b = b.slice(at, 2000)
                for doc, ids in zip(part_b.column(0).to_pylist(), encoder.encode_batch(part_b.column(1).to_pylist()), strict=True):
                    ids = ids if end_id is None else np.append(ids, np.uint32(end_id))
                    if doc_ids and have + len(ids) > shard_ids:
                        yield flush()
                    doc_ids.append(doc)
                    arrays.append(ids)
                    have += len(ids)
        if doc_ids:
            yield flush()

    with common.batch_rows(spark, common.BATCH):
        return common.checkpoint(ordered.mapInArrow(run, MANIFEST))


def with_starts(manifest: DataFrame, group: int = 1024) -> DataFrame:
    """``start``: the ids of all shards before. Sums within groups of parts first, so that no task sees all shards."""
    m = manifest.withColumn("g", F.floor(F.col("part") / group))
    inner = m.withColumn("inner", F.sum("n_ids").over(Window.partitionBy("g").orderBy("part", "seq")) - F.col("n_ids"))
    groups = m.groupBy("g").agg(F.sum("n_ids").alias("n")).withColumn("before", F.sum("n").over(Window.orderBy("g")) - F.col("n"))
    return inner.join(groups.select("g", "before"), "g").withColumn("start", F.col("inner") + F.col("before")).drop("g", "inner", "before")


def read_back(manifest: DataFrame, folder: str, columns, schema: str) -> DataFrame:
    """A row for each document of the shards, read from the files. ``columns(list of id arrays)`` gives the columns after doc_id and start."""
    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pafs.FileSystem.from_uri(folder)
        for b in batches:
            for path, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                with fs.open_input_stream(path) as f:
                    shard = Shard(f.read())
                ends = shard.ends
                at = 0
                while at < len(ends):
                    lo = int(ends[at - 1]) if at else 0
                    to = max(at + 1, min(at + 1000, int(np.searchsorted(ends, lo + (1 << 20), "right"))))
                    block = shard.slice(lo, int(ends[to - 1]))
                    own = ends[at:to] - lo
                    arrays = np.split(block, own[:-1])
                    starts = start + lo + np.concatenate([[0], own[:-1]])
                    yield pa.RecordBatch.from_arrays([pa.array(shard.doc_ids[at:to], pa.int64()), pa.array(starts, pa.int64()), *columns(arrays)], names=[c.split()[0] for c in schema.split(", ")])
                    at = to

    return with_starts(manifest).select("path", "start").repartition(n).mapInArrow(run, schema)


def token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int | None, columns, schema: str, shard_ids: int = 16 << 20) -> DataFrame:
    return read_back(write(docs, folder, tokenizer, end_id, shard_ids), folder, columns, schema)


def contract_columns(arrays: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([len(a) for a in arrays], pa.int64()), pa.array([zlib.crc32(a.astype("<u4").tobytes()) for a in arrays], pa.int64())]


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = common.read(spark, sf_dir, "documents")
    return common.stored(token_files(docs, common.work_path(spark, "token-ids"), public_tokenizers.path("word_bpe_49k.json"), 2, contract_columns, "doc_id long, start long, n_tokens long, ids_crc32 long"), "tokens")
