"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

An item is found in a document when at least ``threshold`` of the item's distinct shingles of five words are among the document's.
Items are parted by their number of shingles, in powers of two. Each keeps a MinHash sketch, its smallest shingle hashes: as many as it may lack, and HITS more.
A document's sketch for a partition is those of its hashes that are no larger than the largest in that partition's sketches, so a sparse one for large items and a dense one for small ones.
How many of an item's sketch are in the document's estimates the containment, however much longer the document is. An item of q shingles of which ``need`` must be
there can lack q - need; a containing document thus has at least HITS (or, of small items, ``need``) of its sketch, so the candidate search loses nothing. Candidates are
counted on all hashes, then on the shingles themselves.

(Banded signatures were not taken: a 20,000-word document has a Jaccard similarity of about 0.002 with a 40-word
item, for which no number of bands that fits finds them reliably. Containment of bottom sketches does not depend on the document's length.)

The items' tables are sent to every task. Items that would need more than ``block_bytes`` there (about four times their text) are searched in several blocks, one after another, each against all documents.

Defined results: items of fewer than five words are one shingle of all their words, and found as that many words in a row; empty and null items are never
found; null texts contain nothing; texts of any length are searched whole; repeated items and documents give a row each; rows of a null id are reported with it; an empty table gives no rows; only the ids and texts are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

HITS = 4
BLOCK_BYTES = 64 << 20


def shingle_set(ws: list[str], n: int) -> set[tuple[str, ...]]:
    return {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)} if ws else set()


class Part:
    """The sketches of one size partition: hashes in order and the item of each."""

    def __init__(self, own: list[tuple[int, np.ndarray]], need: int) -> None:
        hashes, owners = np.concatenate([h for _, h in own]), np.repeat([i for i, _ in own], [len(h) for _, h in own])
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.owners, self.largest, self.need = hashes[order], owners[order], hashes.max(), need

    def hits(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and how many of their sketch are in the sketch of a document with the sorted hashes ``h``."""
        sketch = h[: np.searchsorted(h, self.largest, "right")]
        lo = np.searchsorted(self.hashes, sketch)
        at = np.flatnonzero(self.hashes[np.minimum(lo, len(self.hashes) - 1)] == sketch)
        if not len(at):
            return at, at
        lo, each = lo[at], np.searchsorted(self.hashes, sketch[at], "right") - lo[at]
        places = np.repeat(lo - (np.cumsum(each) - each), each) + np.arange(each.sum())
        return np.unique(self.owners[places], return_counts=True)


class Sketches:
    """The items' tables. ``items`` are (id, text)."""

    def __init__(self, items: list[tuple], threshold: float = common.THRESHOLD, n: int = common.SHINGLE_WORDS) -> None:
        seen = common.Hashes()
        self.items: list[tuple] = []  # id, text, words a shingle, hashes, shingles needed, hits needed on the sketch
        parts: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}
        for item, text in items:
            ws = common.words(text or "")
            if ws:
                k = min(n, len(ws))
                h = common.shingle_hashes(ws, seen, k)
                need = math.ceil(threshold * len(h) - 1e-9)
                sketch = h[: len(h) - need + HITS]
                parts.setdefault((k, len(h).bit_length()), []).append((len(self.items), sketch))
                self.items.append((item, text, k, h, need, len(sketch) - (len(h) - need)))
        self.parts = {key: Part(own, min(self.items[i][4] for i, _ in own)) for key, own in sorted(parts.items())}
        self.lengths = sorted({k for k, _ in self.parts})

    def candidates(self, ws: list[str], seen: common.Hashes) -> dict[int, np.ndarray]:
        """Items with enough sketch hashes in the document's, and the document's hashes for their shingle length."""
        found: dict[int, np.ndarray] = {}
        for k in self.lengths:
            if len(ws) < k:
                continue
            h = common.shingle_hashes(ws, seen, k)
            for (length, _), part in self.parts.items():
                if length == k and len(h) >= part.need:
                    for i, n in zip(*(x.tolist() for x in part.hits(h)), strict=True):
                        if n >= self.items[i][5]:
                            found[i] = h
        return found

    def search(self, text: str, seen: common.Hashes) -> list[tuple]:
        """(item, shared shingles, shingles of the item) for the items that ``text`` contains."""
        ws = common.words(text)
        out, exact = [], {}
        for i, h in sorted(self.candidates(ws, seen).items()):
            item, own, k, hashes, need, _ = self.items[i]
            if (h[np.minimum(np.searchsorted(h, hashes), len(h) - 1)] == hashes).sum() < need:
                continue
            if k not in exact:
                exact[k] = shingle_set(ws, k)
            shingles = shingle_set(common.words(own), k)
            shared = len(shingles & exact[k])
            if shared >= need:
                out.append((item, shared, len(shingles)))
        return out


def blocks(items: DataFrame, threshold: float, block_bytes: int) -> Iterator[tuple[Sketches, bool]]:
    """The tables of ``items(item_id, text)`` in blocks, and whether there is one only. What the driver gets at once is bounded by ``block_bytes``, but for a longer single item."""
    it = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    size = it.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    n = max(1, math.ceil((4 * size.b + 400 * size.n) / block_bytes))
    if n > 1:
        it = common.checkpoint(it.withColumn("block", F.pmod(F.xxhash64("item_id", "text", F.monotonically_increasing_id()), F.lit(n))))
    for k in range(n):
        got = (it if n == 1 else it.where(F.col("block") == k).drop("block")).collect()
        yield Sketches(sorted(((r[0], r[1]) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[1])), threshold), n == 1


def search(docs: DataFrame, items: DataFrame, threshold: float = common.THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(doc_id, item_id, shared, item_shingles, containment)`` for every document of ``docs(doc_id, text)`` and item of ``items(item_id, text)`` found in it."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL")
    found = []
    for sketches, only in blocks(items, threshold, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(sketches)
        found.append(scan(d, shared))
        if not only:
            found[-1] = common.stored(found[-1], "leaks")
            shared.destroy()
    return reduce(DataFrame.unionByName, found)


def keep_clean(docs: DataFrame, items: DataFrame, threshold: float = common.THRESHOLD, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs``, all columns, that contain none of ``items``."""
    at = docs.columns.index("text")

    def make(shared):
        def f():
            s, seen = shared.value, common.Hashes()
            return lambda b: b.filter(pa.array([not s.search(t, seen) for t in common.texts(b.column(at))], pa.bool_()))

        return f

    for sketches, only in blocks(items, threshold, block_bytes):
        shared = docs.sparkSession.sparkContext.broadcast(sketches)
        docs = common.map_rows(docs, make(shared), docs.schema)
        if not only:
            docs = common.stored(docs, "clean")
            shared.destroy()
    return docs


SCHEMA = "doc_id long, item_id long, shared long, item_shingles long, containment double"


def found_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.float64()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["doc_id", "item_id", "shared", "item_shingles", "containment"])


def scan(docs: DataFrame, shared) -> DataFrame:
    def make():
        s, seen = shared.value, common.Hashes()

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            return found_batch([(doc, item, n, q, n / q) for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for item, n, q in s.search(text, seen)])

        return f

    return common.map_rows(docs, make, SCHEMA)


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return common.stored(search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark")), "leaks")


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '\S+') AS w FROM documents WHERE text IS NOT NULL),
i AS (SELECT item_id, regexp_extract_all(lower(text), '\S+') AS w FROM benchmark WHERE text IS NOT NULL),
ik AS (SELECT item_id, w, least(5, len(w)) AS k FROM i WHERE len(w) > 0),
si AS (SELECT DISTINCT item_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM ik)),
qi AS (SELECT item_id, count(*) AS q FROM si GROUP BY item_id),
ks AS (SELECT DISTINCT k FROM ik),
sd AS (SELECT DISTINCT doc_id, k, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, k, w, unnest(range(1, len(w) - k + 2)) AS p FROM d, ks WHERE len(w) >= k))
SELECT doc_id, item_id, count(*) AS shared, any_value(q) AS item_shingles, count(*) / any_value(q) AS containment
FROM sd JOIN si USING (k, s) JOIN qi USING (item_id) GROUP BY doc_id, item_id HAVING count(*) >= ceil(0.8 * any_value(q) - 1e-9)
"""
