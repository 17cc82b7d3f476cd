"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the bag of its letter n-grams (3 to 5, with word bounds) and itself, hashed into buckets with an embedding each; a word's vector is
their mean, a text's vector the mean of its words', and a softmax layer maps it to the two classes. Embeddings and layer learn together (Adagrad,
mini-batches), so a misspelling never seen in training gets its vector from the n-grams that it shares.

Labels are learnt from at most ``sample`` labelled rows a class and ``sample_bytes`` of text, those with the smallest hash of doc_id; a row is held out
where crc32(doc_id as text) mod 5 is 0. As that sample may hold another share of toxic rows than the labels do, its log-odds are moved by the
difference (the usual correction of an intercept). Scoring covers all rows and whole texts.

Defined results: null and empty texts get the score of no words; rows whose label or doc_id is null are not learnt from; with labels of one class or
none, every score is that class's share (0 without labels); repeated labels of a doc_id are learnt once each; of repeated documents of a labelled doc_id one is learnt; a null doc_id
is scored, held out false; long texts are scored whole (and learnt whole or not at all); an empty table gives no rows; only doc_id and text are read.
"""

from __future__ import annotations

import math
import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

WORD = re.compile(r"\w+")
BUCKETS = 1 << 17
DIM = 8
SAMPLE, SAMPLE_BYTES = 2500, 64 << 20
KEPT = 200_000


def grams(word: str, buckets: int = BUCKETS) -> list[int]:
    w = f"<{word}>"
    h = xxhash.xxh32_intdigest
    found = {w}
    for n in (3, 4, 5):
        found.update(w[i : i + n] for i in range(len(w) - n + 1))
    return sorted({h(g) % buckets for g in found})


@dataclass
class Model:
    emb: np.ndarray  # a row a bucket
    layer: np.ndarray  # a row a dimension, a column a class
    bias: np.ndarray

    def parts(self) -> np.ndarray:
        """A bucket's part of the log-odds: as all before the softmax is linear, one number a bucket is all that scoring needs."""
        return self.emb @ (self.layer[:, 1] - self.layer[:, 0])

    def scorer(self):
        """A function of a list of texts. It keeps words' parts of the log-odds in two generations: a full one becomes the old one."""
        known: dict[str, float] = {}
        old: dict[str, float] = {}
        weight, bias = self.parts().astype(np.float64).tolist(), float(self.bias[1] - self.bias[0])

        def scores(texts: list[str]) -> list[float]:
            nonlocal known, old
            found = [WORD.findall(t.lower()) for t in texts]
            if len(known) > KEPT:
                known, old = {}, known
            for w in set().union(*found).difference(known):
                part = old.get(w)
                if part is None:
                    g = grams(w, len(weight))
                    part = sum([weight[i] for i in g]) / len(g)
                known[w] = part
            odds = [bias + (sum(map(known.__getitem__, ws)) / len(ws) if ws else 0.0) for ws in found]
            return [1.0 / (1.0 + math.exp(-min(max(x, -500.0), 500.0))) for x in odds]

        return scores


def bags(texts: list[str], buckets: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """Each text as numbers of words and their weights in its vector; all words' buckets in one array, and where each word's begin there."""
    number: dict[str, int] = {}
    flat, ends, out = array("i"), array("q", [0]), []
    for t in texts:
        count = Counter(WORD.findall(t.lower()))
        for w in count:
            if w not in number:
                number[w] = len(number)
                flat.extend(grams(w, buckets))
                ends.append(len(flat))
        n = len(count)
        out.append((np.fromiter(map(number.__getitem__, count), np.int32, n), np.fromiter(count.values(), np.float32, n) / max(count.total(), 1)))
    return out, np.array(flat, np.int32), np.array(ends, np.int64)


def train(texts: list[str], labels: np.ndarray, *, buckets: int = BUCKETS, dim: int = DIM, epochs: int = 8, rate: float = 3.0, seed: int = 7, batch: int = 32, share: float | None = None) -> Model:
    """Fit on texts in the given order; the same input gives the same model. ``share`` of toxic rows, if it is not that of ``labels``, moves the log-odds."""
    own = float(labels.mean()) if len(labels) else 0.0
    if own in (0.0, 1.0):
        return Model(np.zeros((buckets, dim), np.float32), np.zeros((dim, 2), np.float32), np.array([0.0, 40.0 if own else -40.0], np.float32))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (buckets, dim)).astype(np.float32)
    layer = rng.normal(0, 0.1, (dim, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    g_emb, g_layer, g_bias = np.full((buckets, dim), 1e-6, np.float32), np.full_like(layer, 1e-6), np.full_like(bias, 1e-6)
    rows, flat, starts = bags(texts, buckets)
    for epoch in range(epochs):
        order = rng.permutation(len(rows))
        lr = rate * (1 - epoch / epochs)
        for at in range(0, len(order), batch):
            pick = order[at : at + batch]
            sizes = np.array([len(rows[i][0]) for i in pick])
            idx = np.concatenate([rows[i][0] for i in pick])
            val = np.concatenate([rows[i][1] for i in pick])
            doc = np.repeat(np.arange(len(pick)), sizes)
            words, place = np.unique(idx, return_inverse=True)
            each = starts[words + 1] - starts[words]
            first = np.cumsum(each) - each
            held = flat[np.repeat(starts[words] - first, each) + np.arange(each.sum())]
            vec = np.zeros((len(pick), dim), np.float32)
            if len(words):
                means = np.add.reduceat(emb[held], first) / each[:, None].astype(np.float32)
                full = np.flatnonzero(sizes)
                vec[full] = np.add.reduceat(means[place] * val[:, None], (np.cumsum(sizes) - sizes)[full])
            z = vec @ layer + bias
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            y = labels[pick].astype(int)
            err = p
            err[np.arange(len(pick)), y] -= 1
            err /= len(pick)
            d_layer, d_bias, d_vec = vec.T @ err, err.sum(0), err @ layer.T
            back = d_vec[doc] * val[:, None]
            d_mean = np.stack([np.bincount(place, back[:, j], len(words)) for j in range(dim)], 1) / each[:, None]
            uniq, inv = np.unique(held, return_inverse=True)
            d_emb = np.stack([np.bincount(inv, np.repeat(d_mean[:, j], each), len(uniq)) for j in range(dim)], 1).astype(np.float32)
            g_emb[uniq] += d_emb**2
            emb[uniq] -= lr * d_emb / np.sqrt(g_emb[uniq])
            g_layer += d_layer**2
            layer -= lr * d_layer / np.sqrt(g_layer)
            g_bias += d_bias**2
            bias -= lr * d_bias / np.sqrt(g_bias)
    if share is not None and 0 < share < 1:
        bias[1] += math.log(share / (1 - share)) - math.log(own / (1 - own))
    return Model(emb, layer, bias)


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES, **options) -> Model:
    """Learn from rows that are not held out: at most ``sample`` of each class, together at most ``sample_bytes`` of text, which bounds what the driver gets."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)")
    y = y.where(~held_out(F.col("doc_id"))).withColumn("h", F.xxhash64("doc_id"))
    share = y.agg(F.avg("toxic")).first()[0]
    picked = y.where("toxic = 0").orderBy("h", "doc_id").limit(sample).unionByName(y.where("toxic = 1").orderBy("h", "doc_id").limit(sample))
    ids = picked.select("doc_id", "toxic").collect()
    spark = docs.sparkSession
    few = spark.createDataFrame([(r[0], r[1]) for r in ids], "doc_id long, toxic int")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    d = d.join(F.broadcast(few.select("doc_id").distinct()), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.struct(F.octet_length("text"), F.xxhash64("text"))).alias("text"))
    found = common.checkpoint(d)  # at most 2 * sample rows
    sizes = sorted(found.select(F.xxhash64("doc_id"), F.octet_length("text"), "doc_id").collect())
    total = np.cumsum([r[1] for r in sizes])
    held = spark.createDataFrame([(r[2],) for r, n in zip(sizes, total, strict=True) if n <= sample_bytes], "doc_id long")
    got = sorted((r[0], r[1], r[2]) for r in found.join(F.broadcast(held), "doc_id").join(F.broadcast(few), "doc_id").select("doc_id", "toxic", "text").collect())
    texts, toxic = [r[2] for r in got], np.array([r[1] for r in got])
    del got
    try:
        return train(texts, toxic, share=share, **options)
    finally:
        del texts
        common.trim()


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, held_out, score, predicted)`` for every row of ``docs(doc_id, text)``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB

    def make():
        f = shared.value.scorer()

        def run(b: pa.RecordBatch) -> pa.RecordBatch:
            s = np.array(f(common.texts(b.column(2))))
            return pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s, pa.float64()), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

        return run

    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return common.map_rows(d.select("doc_id", held_out(F.col("doc_id")), "text"), make, "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that the model does not call toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def make():
        f = shared.value.scorer()
        return lambda b: b.filter(pa.array([x < 0.5 for x in f(common.texts(b.column(at)))], pa.bool_()))

    return common.map_rows(docs, make, docs.schema)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return common.stored(score(docs, fit(docs, common.read(spark, sf_dir, "labels"))), "toxicity")
