"""Byte-level BPE encoding and decoding by corpus-level merge replay.

Chunks of rows send their distinct words to the words' owners, so each distinct word of the corpus is replayed once, by the owner of its
hash; its tokens come back to the chunks that have it. An owner lays its words out one after another as cells, each a token. An inverted
index maps every pair of neighbouring tokens to the cells where it begins; a heap gives the pairs in rank order. Applying a merge visits
only the cells that the index lists, and only their neighbours' pairs enter the index anew. Words are then put back into texts.
Words that are tokens of the vocabulary need no merge and are not sent.

A frequent word is sent once a chunk, not once a place. A task holds the distinct words of one chunk or of one bucket of owners.

Where a merge makes a pair of lower rank than its own (possible with odd vocabularies), the word's remaining places wait until
that pair was applied, so each word gets exactly the merges of an encoder that works on the word alone.

Defined results: null and empty texts have no tokens; special strings are ordinary text; texts of any length are encoded whole;
decoding gives back the text's bytes; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common
from .chunks import ChunkBlobs, by_bucket, chunked, write_by_chunk
from .token_counts import PLAIN, plain_pieces

#: Words that share one replay, for memory: an owner's words go in ranges of so many.
TOGETHER = 50_000
#: Distinct words that a task gathers of a chunk before it sends them on.
GATHERED = 500_000
#: Buckets of words for each shuffle partition: an owner holds one at a time.
BUCKETS = 4
#: Between words; no UTF-8 text has this byte.
BETWEEN = b"\xff"


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks = ranks
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.decimal = {r: str(r) for r in self.bytes_of}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.pattern = regex.compile(pattern)
        self.plain = plain_pieces(pattern, spaces=False)
        self.pair_rank: dict[tuple[int, int], int] = {}

    def rank(self, a: int, b: int) -> int:
        """The rank of the merge of two tokens, -1 if there is none."""
        r = self.pair_rank.get((a, b))
        if r is None:
            if len(self.pair_rank) > 400_000:
                self.pair_rank.clear()
            r = self.pair_rank[a, b] = self.ranks.get(self.bytes_of[a] + self.bytes_of[b], -1)
        return r

    def encode_words(self, words: list[str]) -> list[tuple[int, ...]]:
        """The tokens of each word, by replaying all merges over all words at once."""
        ranks, whole = self.ranks, [None] * len(words)
        token: list[int] = []  # a cell's token, -1 where it was merged into one before it; -2 between words
        bounds = []
        for i, w in enumerate(words):
            data = w.encode()
            if data in ranks:  # a word of the vocabulary is its one token
                whole[i] = (ranks[data],)
                continue
            bounds.append((i, len(token), len(data)))
            token += [self.single[b] for b in data]
            token.append(-2)
        n = len(token)
        after, before = list(range(1, n + 1)), list(range(-1, n))
        index: dict[tuple[int, int], list[int]] = {}
        for at, pair in enumerate(zip(token, token[1:], strict=False)):
            if pair[0] != -2 and pair[1] != -2:
                if pair in index:
                    index[pair].append(at)
                else:
                    index[pair] = [at]
        heap: list[tuple[int, tuple[int, int]]] = []
        rank = self.rank
        for pair in index:
            if (r := rank(*pair)) >= 0:
                heappush(heap, (r, pair))
        while heap:
            r, pair = heappop(heap)
            places = index.pop(pair, None)
            if places is None:
                continue
            left, right = pair
            places.sort()
            for k, at in enumerate(places):
                if token[at] != left:
                    continue
                nxt = after[at]
                if token[nxt] != right:
                    continue
                token[at], token[nxt] = r, -1
                far = after[at] = after[nxt]
                before[far] = at
                low = r
                if (t := token[far]) >= 0:
                    new = (r, t)
                    if new in index:
                        index[new].append(at)
                    elif (q := rank(r, t)) >= 0:
                        index[new] = [at]
                        heappush(heap, (q, new))
                        low = min(low, q)
                prev = before[at]
                if prev >= 0 and (t := token[prev]) >= 0:
                    new = (t, r)
                    if new in index:
                        index[new].append(prev)
                    elif (q := rank(t, r)) >= 0:
                        index[new] = [prev]
                        heappush(heap, (q, new))
                        low = min(low, q)
                if low < r and k + 1 < len(places):  # a lower pair came up: it goes first, the other places wait
                    index.setdefault(pair, []).extend(places[k + 1 :])
                    heappush(heap, (r, pair))
                    break
        for i, at, size in bounds:
            whole[i] = tuple([t for t in token[at : at + size] if t >= 0])
        return whole

    def split(self, text: str) -> list[str]:
        return (self.plain if PLAIN.match(text) else self.pattern).findall(text)

    def encode_all(self, words: list[str]) -> list[tuple[int, ...]]:
        """``encode_words`` in ranges that fit in memory."""
        return [t for at in range(0, len(words), TOGETHER) for t in self.encode_words(words[at : at + TOGETHER])]

    def encode_batch(self, texts: list[str]) -> list[list[tuple[int, ...]]]:
        """For every text, its words' tokens, with these texts as the corpus."""
        found = [self.split(t) for t in texts]
        words = list(set().union(*found))
        tokens = dict(zip(words, self.encode_all(words), strict=True))
        return [[tokens[w] for w in ws] for ws in found]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@cache
def kept_replay(ranks_path: str, pattern: str) -> MergeReplay:
    """One a worker process, for the tasks that follow too."""
    return MergeReplay(load_ranks(ranks_path), pattern)


def slices(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each chunk in a batch of (chunk, row, doc_id, text)."""
    chunks = batch.column(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield int(chunks[a]), batch.slice(a, b - a)


def words_of_chunks(n: int, ranks_path: str, pattern: str):
    """The distinct words of each chunk that are no tokens themselves, by bucket: ``(bucket, chunk, blob)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = kept_replay(ranks_path, pattern)
        now, seen = None, set()

        def sent() -> Iterator[pa.RecordBatch]:
            held: dict[int, list[bytes]] = {}
            for w in map(str.encode, seen):
                if w not in replay.ranks:
                    held.setdefault(xxhash.xxh64_intdigest(w) * n >> 64, []).append(w)
            seen.clear()
            if held:
                yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array([now] * len(held), pa.int64()), pa.array([BETWEEN.join(sorted(ws)) for ws in held.values()], pa.binary())], ["bucket", "chunk", "blob"])

        for batch in batches:
            for chunk, rows in slices(batch):
                if chunk != now or len(seen) > GATHERED:
                    yield from sent()
                    now = chunk
                for t in common.texts(rows.column(3)):
                    seen.update(replay.split(t))
        yield from sent()
        common.trim()

    return run


def planes(x: np.ndarray) -> bytes:
    """32-bit numbers byte by byte, as high bytes that are mostly zero pack well."""
    return np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def replay_owned(ranks_path: str, pattern: str):
    """The owners: the words of a bucket from all chunks are replayed once; every chunk gets its words with their tokens, ``(chunk, blob)``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay = kept_replay(ranks_path, pattern)
        for rows in by_bucket(batches):
            words = sorted(set().union(*(blob.split(BETWEEN) for _, blob in rows)))
            tokens = dict(zip(words, replay.encode_all([w.decode() for w in words]), strict=True))
            for at in range(0, len(rows), 64):
                chunks, blobs = [], []
                for chunk, blob in rows[at : at + 64]:
                    of = [tokens[w] for w in blob.split(BETWEEN)]
                    numbers = [len(of), *map(len, of), *(i for t in of for i in t)]
                    chunks.append(chunk)
                    blobs.append(len(blob).to_bytes(8, "little") + blob + planes(np.array(numbers, np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["chunk", "blob"])
        common.trim()

    return run


class Codes(dict):
    """A chunk's words with their tokens as bytes, four a token; those that are tokens of the vocabulary are added when asked for."""

    def __init__(self, ranks: dict[bytes, int], blobs: list[bytes]) -> None:
        self.ranks = ranks
        for b in blobs:
            end = 8 + int.from_bytes(b[:8], "little")
            words = b[8:end].decode("utf-8", "surrogateescape").split("\udcff")
            numbers = np.ascontiguousarray(np.frombuffer(b, np.uint8, offset=end).reshape(4, -1).T).view("<u4").ravel()
            to = np.cumsum(numbers[1 : len(words) + 1].astype(np.int64) * 4).tolist()
            data = numbers[len(words) + 1 :].tobytes()
            self.update(zip(words, (data[i:j] for i, j in zip([0, *to], to, strict=False)), strict=True))

    def __missing__(self, word: str) -> bytes:
        code = self[word] = self.ranks[word.encode()].to_bytes(4, "little")
        return code


def replay_batches(docs: DataFrame, ranks_path: str, pattern: str, columns: str, out) -> DataFrame:
    """``docs`` (doc_id and text) by batches, as a stored table; ``out(replay, doc_ids, ids of each text)`` makes the columns."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, parts = chunked(docs), n * BUCKETS
    with common.batch_rows(spark, 256):
        to_owner = rows.mapInArrow(words_of_chunks(parts, ranks_path, pattern), "bucket int, chunk long, blob binary").repartition(n, "bucket").sortWithinPartitions("bucket")
        answers = write_by_chunk(to_owner.mapInArrow(replay_owned(ranks_path, pattern), "chunk long, blob binary"), common.work_path(spark, "words"), n, parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        replay, known = kept_replay(ranks_path, pattern), ChunkBlobs(answers, parts)
        now = codes = None
        for batch in batches:
            for chunk, part in slices(batch):
                if chunk != now:
                    codes = None
                    now, codes = chunk, Codes(replay.ranks, known.blobs(chunk))
                code = codes.__getitem__
                ids = [np.frombuffer(b"".join(map(code, replay.split(t))), "<u4") for t in common.texts(part.column(3))]
                yield out(replay, part.column(2), ids)
        codes = None
        common.trim()

    done = common.stored(rows.mapInArrow(run, columns), "encoded", 256)
    common.drop(spark, answers)
    return done


def encode(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, ids)`` for every row of ``docs(doc_id, text)``."""
    out = lambda r, doc_ids, ids: pa.RecordBatch.from_arrays([doc_ids, pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], ["doc_id", "ids"])
    return replay_batches(docs, ranks_path, pattern, "doc_id long, ids array<int>", out)


def decode(encoded: DataFrame, ranks_path: str) -> DataFrame:
    """``(doc_id, text binary)`` from ``(doc_id, ids)``; null ids give null."""

    def make():
        table = {r: b for b, r in load_ranks(ranks_path).items()}

        def f(b: pa.RecordBatch) -> pa.RecordBatch:
            got = [None if x is None else b"".join(map(table.__getitem__, x)) for x in b.column(1).to_pylist()]
            return pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.binary())], ["doc_id", "text"])

        return f

    return common.map_rows(encoded.select("doc_id", "ids"), make, "doc_id long, text binary")


def round_trip(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)``: texts are encoded, the ids decoded again."""
    h = lambda x: hashlib.sha256(x).hexdigest()

    def out(r: MergeReplay, doc_ids: pa.Array, ids: list[np.ndarray]) -> pa.RecordBatch:
        decimal, listed = r.decimal.__getitem__, [x.tolist() for x in ids]
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([len(x) for x in listed], pa.int64()), pa.array([h(" ".join(map(decimal, x)).encode()) for x in listed], pa.string()), pa.array([h(r.decode(x)) for x in listed], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return replay_batches(docs, ranks_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", out)


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return round_trip(common.read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
