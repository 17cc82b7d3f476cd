"""N-gram Jaccard join with Bayesian candidate pruning.

Two texts are linked when the Jaccard similarity of their sets of word 5-grams is at least 0.8. The steps:

1. Every text becomes its set of shingle hashes, a MinHash signature and band keys. Texts with one and the same set are one class from here on,
   with a number of its own; a group of copies of any size is one row.
2. Classes that share a band key are joined to the key's smallest class (an aggregation and a join; no pairs). Components of these edges are clusters: all links lie inside one.
   A pair at similarity 0.8 shares none of 64 bands of 7 values with a probability below 3e-7, and then may still meet in its cluster.
3. A cluster is dealt out for comparison in the cheaper of two ways, by the rows that have to be sent. A dense one goes in blocks, each pair of blocks to a task. A wide one of more than
   ONE_BLOCK members, chained over many texts, goes by its band keys: those with the same members are one unit, and a pair is compared in the
   unit of the first band that it shares, and nowhere else; units that are large are dealt out in blocks in turn. A task compares in memory each of its pairs whose sizes allow the threshold: 32 signature values
   at a time, dropped as soon as the posterior probability (uniform prior) that the similarity reaches the threshold is below ``tolerance``. The pairs
   left are verified exactly on the shingle hashes. The task returns, for each member, its number of links and a root of its linked group: never pairs.
4. The links are summed, the roots joined into classes.

A row's ``n_links`` counts the other rows linked with it, its copies included. ``class_id`` is the smallest doc_id of its component.

Defined results: words are runs of characters other than white space, in lower case; a text of one to four words is one shingle; a text without words (or null) is linked with
nothing, its class is its doc_id; repeated rows are copies; rows of a null doc_id link like others, and their class is null only where no row of the class has a doc_id; of ties, ``without_near_copies`` keeps
the smallest doc_id, then the first place; texts of any length are compared whole; an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import FILE, ROW

BANDS, ROWS = 64, 7
STEP = 32
TOLERANCE = 1e-9
#: Members of clusters (about 60 bytes each) that are sent to the tasks that read texts; more are joined by a shuffle.
MEMBERS = 200_000
#: Bounds of a block. A cluster of more than ONE_BLOCK members has at least SPREAD * sqrt(members) blocks, hence about its number of members / 12
#: pairs of blocks for as many tasks, while a member is sent to no more than that many tasks.
BLOCK_DOCS, BLOCK_SHINGLES = 2048, 1_000_000
ONE_BLOCK, SPREAD = 256, 0.4
#: Classes of at least this share of all rows are joined by broadcast; there are at most HOT of them (about 50 bytes each).
HOT = 50_000


def permutations(k: int, seed: int = 20_240_501) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(seed)
    return r.integers(0, 1 << 31, k, dtype=np.uint32) * np.uint32(2) + np.uint32(1), r.integers(0, 1 << 32, k, dtype=np.uint64).astype(np.uint32)


class MinHash:
    def __init__(self, k: int = BANDS * ROWS) -> None:
        self.a, self.b = permutations(k)

    def signature(self, hashes: np.ndarray) -> np.ndarray:
        """The least value of each permutation over a set that is not empty."""
        x = (hashes >> np.uint64(32)).astype(np.uint32)
        out = np.full(len(self.a), 0xFFFFFFFF, np.uint32)
        for at in range(0, len(x), 256):
            np.minimum(out, (x[at : at + 256, None] * self.a + self.b).min(0), out=out)
        return out


def band_keys(sig: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key of each band, of its number and values."""
    s = sig.reshape(bands, rows).astype(np.uint64)
    key = np.arange(1, bands + 1, dtype=np.uint64)
    for j in range(rows):
        key = common.mix(key * np.uint64(0x9E3779B97F4A7C15) + s[:, j])
    return key.view(np.int64)


def least_matches(n: int, threshold: float, tolerance: float) -> int:
    """The fewest of ``n`` equal values for which the posterior probability of similarity >= threshold is not below ``tolerance``.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), whose upper tail at t is P(Binomial(n + 1, t) <= m).
    """
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        if total >= tolerance:
            return m
    return n


class Verifier:
    """Links among the members of one or two blocks."""

    def __init__(self, threshold: float = common.THRESHOLD, tolerance: float = TOLERANCE, k: int = BANDS * ROWS) -> None:
        self.threshold = threshold
        self.steps = [(lo, min(lo + STEP, k), least_matches(min(lo + STEP, k), threshold, tolerance)) for lo in range(0, k, STEP)]
        self.minhash = MinHash(k)
        self.counts = {"pairs": 0, "verified": 0}

    def links(self, sets: list[np.ndarray], mult: np.ndarray, side: np.ndarray | None, bands: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """For each set its number of linked rows and the place of a root. With ``side`` only pairs across the two sides are compared,
        with ``bands`` (64 bits) only those whose first common band is among these."""
        n = len(sets)
        order = np.argsort([len(s) for s in sets], kind="stable")
        sets = [sets[i] for i in order]
        sizes = np.array([len(s) for s in sets])
        sig = np.stack([self.minhash.signature(s) for s in sets])
        flat = np.concatenate(sets)
        vocab, ids = np.unique(flat, return_inverse=True)
        starts = np.concatenate([[0], np.cumsum(sizes)])
        mark = np.zeros(len(vocab), bool)
        m = mult[order]
        own = None if side is None else side[order]
        keys = None if bands == -1 else np.stack([band_keys(x) for x in sig])
        mine_bits = np.array([bands >> b & 1 for b in range(BANDS)], bool)
        total = np.zeros(n, np.int64)
        root = np.arange(n)

        def find(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for i in range(n - 1):
            hi = int(np.searchsorted(sizes, math.floor(sizes[i] / self.threshold + 1e-9), "right"))
            js = np.arange(i + 1, hi)
            if own is not None:
                js = js[own[js] != own[i]]
            if keys is not None:
                same = keys[js] == keys[i]
                first = same.argmax(1)
                js = js[same[np.arange(len(js)), first] & mine_bits[first]]
            self.counts["pairs"] += len(js)
            equal = np.zeros(len(js), np.int64)
            for lo, to, least in self.steps:
                if not len(js):
                    break
                equal += (sig[js, lo:to] == sig[i, lo:to]).sum(1)
                keep = equal >= least
                js, equal = js[keep], equal[keep]
            if not len(js):
                continue
            self.counts["verified"] += len(js)
            mine = ids[starts[i] : starts[i + 1]]
            mark[mine] = True
            lengths = sizes[js]
            at = np.cumsum(lengths) - lengths
            places = np.repeat(starts[js] - at, lengths) + np.arange(lengths.sum())
            common_ = np.add.reduceat(mark[ids[places]].astype(np.int64), at)
            mark[mine] = False
            union = sizes[i] + lengths - common_
            js = js[common_ >= self.threshold * union - 1e-9]
            if len(js):
                total[i] += m[js].sum()
                total[js] += m[i]
                a = find(i)
                for j in js.tolist():
                    b = find(j)
                    if a != b:
                        root[b] = a
        out_total, out_root = np.empty(n, np.int64), np.empty(n, np.int64)
        out_total[order] = total
        out_root[order] = order[[find(i) for i in range(n)]]
        return out_total, out_root


def described(placed: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``(FILE, ROW, doc_id, set_hash, n_shingles, bands)`` for every row; a null hash for texts without words."""

    def make():
        seen, minhash = common.Hashes(), MinHash(bands * rows)

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            hashes, ns, keys = [], [], []
            for t in common.texts(b.column(3)):
                h = common.shingle_hashes(common.words(t), seen)
                ns.append(len(h))
                hashes.append(xxhash.xxh3_128_digest(h.tobytes()) if len(h) else None)
                keys.append(band_keys(minhash.signature(h), bands, rows) if len(h) else None)
            return pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(hashes, pa.binary()), pa.array(ns, pa.int32()), pa.array(keys, pa.list_(pa.int64()))], [FILE, ROW, "doc_id", "set_hash", "n_shingles", "bands"])

        return f

    d = placed.select(FILE, ROW, F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_rows(d, make, f"{FILE} long, {ROW} long, doc_id long, set_hash binary, n_shingles int, bands array<long>")


def linked_blocks(members: DataFrame, placed: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``(node, root, links)`` from every task's blocks; ``members(FILE, ROW, node, mult, deals(unit, blocks, bands))``."""
    n = int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    own = placed.select(FILE, ROW, "text").join(members, [FILE, ROW])

    def make():
        seen = common.Hashes()

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            hs = [common.shingle_hashes(common.words(t), seen).tobytes() for t in common.texts(b.column(0))]
            return pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(hs, pa.binary())], ["node", "mult", "deals", "shingles"])

        return f

    deal = "array<struct<unit:long,blocks:int,bands:long>>"
    s = common.map_rows(own.select("text", "node", "mult", "deals"), make, f"node long, mult long, deals {deal}, shingles binary")
    s = s.select("node", "mult", "shingles", F.explode("deals").alias("deal")).select("node", "mult", "shingles", "deal.*")
    s = s.withColumn("block", F.pmod(F.hash("node"), F.col("blocks")))
    s = s.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    s = s.select("unit", "bands", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "node", "mult", "shingles")
    s = s.repartition(n, "unit", "lo", "hi").sortWithinPartitions("unit", "lo", "hi", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        verifier = Verifier(threshold, tolerance)
        now, held = None, []

        def out() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            side = np.array([r[1] for r in held]) if now[2] != now[3] else None
            total, root = verifier.links([np.frombuffer(r[3], np.uint64) for r in held], np.array([r[2] for r in held]), side, now[1])
            nodes = np.array([r[0] for r in held])
            keep = total > 0
            return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(nodes[root][keep]), pa.array(total[keep])], ["node", "root", "links"])

        for b in batches:
            for unit, bands, lo, hi, block, node, mult, shingles in zip(*(b.column(i).to_pylist() for i in range(8)), strict=True):
                if (unit, bands, lo, hi) != now:
                    if held and (x := out()) is not None:
                        yield x
                    now, held = (unit, bands, lo, hi), []
                held.append((node, block, mult, shingles))
        if held and (x := out()) is not None:
            yield x
        held.clear()
        common.trim()

    return s.mapInArrow(run, "node long, root long, links long")


def blocks_of(n, shingles):
    """The number of blocks for a group of ``n`` members with so many shingles."""
    least = F.greatest(F.ceil(n / BLOCK_DOCS), F.ceil(shingles / BLOCK_SHINGLES))
    return F.greatest(least, F.when(n > ONE_BLOCK, F.ceil(F.sqrt(n) * SPREAD)).otherwise(1)).cast("int")


def deals(clusters: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, unit, blocks, bands)``: the groups in which each member of ``clusters(node, root)`` is compared, by blocks of its cluster or by band keys."""
    sized = clusters.join(nodes.select("node", "n_shingles"), "node")
    whole = common.checkpoint(sized.groupBy("root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")).withColumn("blocks", blocks_of(F.col("n"), F.col("shingles"))))
    wide = whole.where(F.col("n") > ONE_BLOCK).select("root", (F.col("n") * F.col("blocks")).alias("rows"))
    by_block = lambda roots: sized.select("node", "root").join(roots, "root").select("node", F.col("root").alias("unit"), "blocks", F.lit(-1).cast("long").alias("bands"))
    if wide.isEmpty():
        return by_block(whole.select("root", "blocks"))
    some = common.checkpoint(sized.join(wide.select("root"), "root", "left_semi"))
    own = nodes.select("node", "bands").join(common.small(some, MEMBERS), "node").select("node", "root", "n_shingles", F.posexplode("bands").alias("band", "key"))
    prints = [F.bit_xor(F.xxhash64("node", F.lit(i))).alias(f"print{i}") for i in (1, 2)]
    buckets = own.groupBy("root", "band", "key").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles"), *prints).where("n > 1")
    buckets = common.checkpoint(buckets)
    same = ["root", "n", "print1", "print2"]
    units = buckets.groupBy(*same).agg(F.min(F.struct("key", "band")).alias("first"), F.max("shingles").alias("shingles"), F.bit_or(F.expr("shiftleft(1L, band)")).alias("mask"))
    units = common.checkpoint(units.select("root", "n", "first.*", "mask", blocks_of(F.col("n"), F.col("shingles")).alias("blocks")))
    cost = units.groupBy("root").agg(F.sum(F.col("n") * F.col("blocks")).alias("cost"))
    chosen = common.checkpoint(wide.join(cost, "root").where("cost < rows").select("root"))
    rest = whole.join(chosen, "root", "left_anti").select("root", "blocks")
    same_key = ["root", "band", "key"]
    by_band = own.join(common.small(common.checkpoint(units.join(chosen, "root", "left_semi").select(*same_key, "blocks", "mask")), MEMBERS), same_key)
    return by_block(rest).unionByName(by_band.select("node", F.col("key").alias("unit"), "blocks", F.col("mask").alias("bands")))


def classified(docs: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    """``(FILE, ROW, doc_id, class_id, n_links, keep_file, keep_row)`` for every row of the ``placed`` docs."""
    p = common.checkpoint(described(docs))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", FILE, ROW, "n_shingles", "bands"))
    classes = p.where("set_hash IS NOT NULL").groupBy("set_hash").agg(first.alias("m"), F.count("*").alias("mult"))
    classes = common.checkpoint(classes.select("set_hash", "m.*", "mult", F.monotonically_increasing_id().alias("node")))
    keys = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    edges = keys.join(shared, "key").where("node != least").select(F.col("node").alias("u"), F.col("least").alias("v"))
    clusters = common.checkpoint(common.components(edges))
    dealt = deals(clusters, classes).groupBy("node").agg(F.collect_list(F.struct("unit", F.col("blocks").cast("int").alias("blocks"), "bands")).alias("deals"))  # one, or at most one a band
    members = classes.select(FILE, ROW, "node", "mult").join(dealt, "node")
    members = common.small(common.checkpoint(members), MEMBERS)
    found = common.checkpoint(linked_blocks(members, docs, threshold, tolerance))
    roots = common.components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    known = classes.select("set_hash", "node", "mult", "no", "doc_id", FILE, ROW).join(links, "node", "left").join(roots, "node", "left")
    known = common.checkpoint(known.withColumn("root", F.coalesce("root", "node")))
    best = known.groupBy("root").agg(F.min(F.struct("no", "doc_id", FILE, ROW)).alias("best"))
    info = known.join(best, "root").select("set_hash", "mult", F.col("best.doc_id").alias("class_id"), F.col(f"best.{FILE}").alias("keep_file"), F.col(f"best.{ROW}").alias("keep_row"), (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"))
    info = common.checkpoint(info)
    large = max(16, p.count() // HOT + 1)
    hot = F.broadcast(info.where(F.col("mult") >= large))
    rows = p.select(FILE, ROW, "doc_id", "set_hash")
    some = rows.where("set_hash IS NOT NULL")
    few = some.join(hot.select("set_hash"), "set_hash", "left_anti").join(info.where(F.col("mult") < large), "set_hash")
    none = rows.where("set_hash IS NULL").select(FILE, ROW, "doc_id", F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.col(FILE).alias("keep_file"), F.col(ROW).alias("keep_row"))
    out = some.join(hot, "set_hash").unionByName(few).select(*none.columns)
    return out.unionByName(none)


def ngram_join(docs: DataFrame, threshold: float = common.THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """``(doc_id, class_id, n_links)`` for every row of ``docs(doc_id, text)``."""
    return common.stored(classified(common.placed(docs), threshold, tolerance).select("doc_id", "class_id", "n_links"), "near-copies")


def without_near_copies(docs: DataFrame, threshold: float = common.THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """One row of every class: of the smallest doc_id, the first by place. Rows without words are no copies of each other."""
    placed = common.placed(docs)
    return common.without(placed, classified(placed, threshold, tolerance).where(f"{FILE} <> keep_file OR {ROW} <> keep_row"))


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join(common.read(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '\S+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + k - 1], ' ') AS s FROM (SELECT doc_id, w, least(5, len(w)) AS k, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS p FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
  JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING count(*) >= 0.8 * (na.n + nb.n - count(*)) - 1e-9
),
c AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT c.node, l.v FROM c JOIN l ON c.other = l.u)
SELECT d.doc_id, m.class_id, coalesce(k.n_links, 0) AS n_links
FROM documents d JOIN (SELECT node, min(other) AS class_id FROM c GROUP BY node) m ON m.node = d.doc_id
LEFT JOIN (SELECT u, count(*) AS n_links FROM l GROUP BY u) k ON k.u = d.doc_id
"""
