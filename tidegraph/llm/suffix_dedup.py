"""Removal of repeated byte strings, with a prefix-free parse.

A byte is removed when a string of ``length`` (50) bytes covers it that also starts in a document with a smaller doc_id. The steps:

1. Parse. A rolling hash of 20 bytes triggers where it is the least in some stretch of 31 in a row, so every string of 50 bytes has exactly one trigger
   that is its own, the first least one, wherever it stands. The strings of one trigger, overlapping, make its phrase (50 to 80 bytes). The corpus is
   the sequence of its phrases; equal phrases at equal triggers have equal strings.
2. Dictionary. Tasks send each distinct phrase of theirs once, as a hash with the smallest document that has it, to the phrase's owner, who finds those known
   from a smaller document: all their strings are repeats. Each distinct trigger goes once a task, with its smallest and largest document,
   to the trigger's owner. One that several documents have is open: other phrases of it may still agree in part.
3. Suffix array. Phrases of open triggers that are not repeats are sent as bytes, and only these. Their owner sorts all suffixes of its part of the dictionary to a
   depth of 50 bytes and reads off the classes of equal strings, hence of the corpus: a string belongs to one trigger, so to one owner.
   A trigger with more than HOT phrases (where a line that a third of all documents have begins or ends) is not left to one owner:
   its strings are sent one by one to owners by their own hash, equal ones of a task once.
4. The answers, grouped by the rows that they concern, are merged into spans.

No step gathers the rows of a frequent phrase, trigger or string: tasks have summed them up before they are sent. Phrases are told apart by 88 bits of hash, open ones by their bytes.

The whole corpus's order is not written out: removal only needs the classes of equal 50-byte strings, which the parse and the dictionary's suffix array give.
Triggers are the least of a stretch instead of zero modulo a number, as a plain modulus leaves strings without a trigger.

Rows are read again in steps 3 and 4 rather than shuffled. They are known by file and row number, or where the input is not a plain scan of
files by their place in a copy in the shared folder. The answers lie in the shared folder,
in a bounded number of files, in the order of blocks of a few thousand rows; a reader that can't see the folder fails.

Defined results: null and empty texts have zero bytes and spans; matches never cross documents; texts of any length are read whole; rows of equal
doc_id do not count as smaller than each other; a null doc_id counts as larger than every other; an empty table gives no rows; only doc_id
and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from . import common
from .chunks import ChunkBlobs, by_bucket, chunked, write_by_chunk

LENGTH, GRAM = 50, 20
PART = 1 << 19
#: Phrases that a task gathers before it sends them on.
FLUSH = 250_000
#: Phrases of one trigger (as the sum of what tasks have) above which its strings are dealt out singly.
HOT = 2048
#: Buckets of the dictionary for each shuffle partition: many, so that they spread evenly and one is small.
BUCKETS = 8
LAST = (1 << 63) - 1
U = np.uint64


@cache
def powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64, and a number for each byte."""
    base, n = 0x9E3779B97F4A7C15, 2 * PART + LENGTH + 1
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(n, b, U)
        p[0] = 1
        out.append(np.cumprod(p))
    return out[0], out[1], np.random.default_rng(11).integers(0, 1 << 63, 256, dtype=U) * U(2) + U(1)


class Phrases:
    """The parse of a batch of texts: arrays with a row a phrase, in the order of the texts."""

    def __init__(self, texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> None:
        parts, group, size = [], [], 0  # a part is (text, offset, bytes); long texts have several, overlapping so that each string is in one
        cols: list[list[np.ndarray]] = []
        for i, t in enumerate(texts):
            for at in range(0, max(len(t) - length + 1, 0), PART):
                b = t[at : at + PART + length - 1]
                if group and size + len(b) > PART:
                    parts.append(group)
                    group, size = [], 0
                group.append((i, at, b))
                size += len(b)
        if group:
            parts.append(group)
        for group in parts:
            cols.append(self.parse(group, length, gram))
        none = [np.empty(0, np.int64)] * 3 + [np.empty(0, U)] * 2
        self.doc, self.lo, self.n, self.trigger, self.phrase = (np.concatenate(c) for c in zip(*cols, strict=True)) if cols else none
        starts = np.flatnonzero(np.diff(self.doc, prepend=-1))
        self.ord = np.arange(len(self.doc)) - np.repeat(starts, np.diff(starts, append=len(self.doc)))

    @staticmethod
    def parse(group: list[tuple[int, int, bytes]], length: int, gram: int) -> list[np.ndarray]:
        """Text, first string's start, number of strings, hash of the trigger and of the phrase."""
        power, inverse, letter = powers()
        buf = np.frombuffer(b"".join(g[2] for g in group), np.uint8)
        n = len(buf)
        sizes = np.array([len(g[2]) for g in group])
        ends = np.cumsum(sizes)
        sums = np.zeros(n + 1, U)
        np.cumsum(letter[buf] * power[:n], out=sums[1:])
        rolling = common.mix((sums[gram:] - sums[:-gram]) * inverse[: n - gram + 1])
        low = U((1 << 22) - 1)
        least = (rolling & ~low) | np.arange(len(rolling), dtype=U)
        span, stretch = 1, length - gram + 1
        while span * 2 <= stretch:
            least = np.minimum(least[:-span], least[span:])
            span *= 2
        if span < stretch:
            least = np.minimum(least[: len(least) - (stretch - span)], least[stretch - span :])
        part = np.repeat(np.arange(len(group)), sizes)[: len(least)]
        at = np.flatnonzero(np.arange(len(least)) + length <= ends[part])
        own = (least[at] & low).astype(np.int64)
        new = np.flatnonzero(np.diff(own, prepend=-1) | np.diff(part[at], prepend=-1))
        lo, hi, trigger = at[new], at[np.append(new[1:], len(at)) - 1], own[new]
        phrase = (sums[hi + length] - sums[lo]) * inverse[lo]
        phrase = common.mix(phrase ^ common.mix((trigger - lo + ((hi - lo) << 8)).astype(U)))
        p = part[lo]
        text = np.array([g[0] for g in group])[p]
        offset = np.array([g[1] for g in group])[p] - (ends - sizes)[p]
        return [text, lo + offset, hi - lo + 1, common.mix(~rolling[trigger]), phrase]  # mixed anew: the least of many hashes is small


def bucket_of(trigger: np.ndarray, n: int) -> np.ndarray:
    return ((trigger >> U(40)) * U(n) >> U(24)).astype(np.int64)


def planes(x: np.ndarray, width: int) -> bytes:
    """The low ``width`` bytes of each number, byte by byte, as high bytes that hardly change pack well."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, at: int, n: int, width: int) -> tuple[np.ndarray, int]:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel(), at + n * width


def pack(columns: list[tuple[np.ndarray, int]]) -> bytes:
    n = len(columns[0][0])
    return n.to_bytes(8, "little") + b"".join(planes(c, w) for c, w in columns)


def unpack(data: bytes, widths: list[int]) -> list[np.ndarray]:
    n, at, out = int.from_bytes(data[:8], "little"), 8, []
    for w in widths:
        c, at = unplanes(data, at, n, w)
        out.append(c)
    return out


ENTRY = [8, 3, 8, 3, 4]  # phrase, low bits of its trigger, doc_id, row, place
TRIGGER = [5, 8, 8, 2]  # trigger, smallest doc_id, largest less smallest, phrases
REPEAT = [3, 4]  # row, place
IS_OPEN = [5, 1]  # trigger, 1 if hot
LOW = (1 << 40) - 1
SPAN = [3, 8, 8]  # row, start, end
OPEN = [5, 8, 3, 8, 1, 1]  # trigger, doc_id, row, start, strings, phrase's length


def split_by(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key with the places that hold it, in order."""
    order = np.argsort(keys, kind="stable")
    cuts = np.flatnonzero(np.diff(keys[order])) + 1
    for places in np.split(order, cuts) if len(keys) else []:
        yield int(keys[places[0]]), places


def ids(column: pa.Array) -> np.ndarray:
    return np.array([LAST if x is None else x for x in column.to_pylist()], np.int64)


def rows_of(batch: pa.RecordBatch, step: int = 500) -> Iterator[tuple[int, np.ndarray, np.ndarray, list[bytes], pa.RecordBatch]]:
    """Slices of one chunk: (chunk, rows, doc_ids, texts, slice) from batches of (chunk, row, doc_id, text)."""
    chunks = batch.column(0).to_numpy(zero_copy_only=False)
    cuts = [0, *(np.flatnonzero(np.diff(chunks)) + 1).tolist(), len(chunks)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        for at in range(a, b, step):
            s = batch.slice(at, min(step, b - at))
            yield int(chunks[at]), s.column(1).to_numpy(zero_copy_only=False).astype(np.int64), ids(s.column(2)), [x.encode() for x in common.texts(s.column(3))], s


def to_dictionary(n: int):
    """Step 2, where texts are read: distinct phrases by bucket, and the rows that a task already knows for repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[np.ndarray]] = {k: [] for k in ("chunk", "row", "doc", "ord", "trigger", "phrase")}
        have = 0

        def flush() -> pa.RecordBatch:
            nonlocal have
            c = {k: np.concatenate(v) for k, v in held.items()}
            for v in held.values():
                v.clear()
            have = 0
            order = np.lexsort((c["doc"], c["trigger"], c["phrase"]))
            phrase, trigger = c["phrase"][order], c["trigger"][order]
            first = np.concatenate([[True], (phrase[1:] != phrase[:-1]) | (trigger[1:] != trigger[:-1])])
            smallest = c["doc"][order][np.maximum.accumulate(np.where(first, np.arange(len(phrase)), 0))]
            repeat = np.empty(len(phrase), bool)
            repeat[order] = c["doc"][order] > smallest
            buckets, chunks, blobs = [], [], []

            def add(bucket: int, chunk: int, blob: bytes) -> None:
                buckets.append(bucket)
                chunks.append(chunk)
                blobs.append(blob)

            for chunk, places in split_by(c["chunk"]):
                known = places[repeat[places]]
                if len(known):
                    add(chunk % n, chunk, b"R" + pack([(c["row"][known], 3), (c["ord"][known], 4)]))
                rest = places[~repeat[places]]
                for b, own in split_by(bucket_of(c["phrase"][rest], n)):
                    own = rest[own]
                    add(b, chunk, b"E" + pack([(c["phrase"][own], 8), (c["trigger"][own], 3), (c["doc"][own], 8), (c["row"][own], 3), (c["ord"][own], 4)]))
                trigger, at = np.unique(c["trigger"][places], return_inverse=True)
                by = places[np.argsort(at, kind="stable")]
                cuts = np.searchsorted(np.sort(at), np.arange(len(trigger)))
                low, high = np.minimum.reduceat(c["doc"][by], cuts), np.maximum.reduceat(c["doc"][by], cuts)
                size = np.minimum(np.add.reduceat(~repeat[by], cuts, dtype=np.int64), 65535)
                for b, own in split_by(bucket_of(trigger, n)):
                    add(b, chunk, b"T" + pack([(trigger[own], 5), (low[own], 8), (high[own] - low[own], 8), (size[own], 2)]))
            return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

        for batch in batches:
            for chunk, rows, docs, texts, _ in rows_of(batch):
                p = Phrases(texts)
                held["chunk"].append(np.full(len(p.doc), chunk))
                held["row"].append(rows[p.doc])
                held["doc"].append(docs[p.doc])
                held["ord"].append(p.ord)
                held["trigger"].append(p.trigger)
                held["phrase"].append(p.phrase)
                have += len(p.doc)
                if have > FLUSH:
                    yield flush()
        if have:
            yield flush()

    return run


def blobs_by_chunk(kind: bytes, chunk: np.ndarray, columns: list[tuple[np.ndarray, int]]) -> pa.RecordBatch:
    found = [(c, kind + pack([(x[at], w) for x, w in columns])) for c, at in split_by(chunk)]
    return pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), pa.array([b for _, b in found], pa.binary())], ["chunk", "blob"])


def passed_on(rows: list[tuple[int, bytes]], kind: bytes) -> Iterator[pa.RecordBatch]:
    """Answers that a task knew by itself, on their way to their chunk."""
    mine = [(c, b) for c, b in rows if b[:1] == kind]
    if mine:
        yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in mine], pa.int64()), pa.array([b for _, b in mine], pa.binary())], ["chunk", "blob"])


def unpacked(rows: list[tuple[int, bytes]], kind: bytes, widths: list[int]) -> list[np.ndarray] | None:
    """The columns of all blobs of a kind, the chunk first."""
    got = [(c, unpack(b[1:], widths)) for c, b in rows if b[:1] == kind]
    return [np.concatenate([np.full(len(x[0]), c) for c, x in got]), *(np.concatenate([x[i] for _, x in got]) for i in range(len(widths)))] if got else None


def own_dictionary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 2, the owners: which phrases are repeats, which triggers are open."""
    for rows in by_bucket(batches):
        yield from passed_on(rows, b"R")
        if (got := unpacked(rows, b"E", ENTRY)) is not None:
            chunk, phrase, trigger, doc, row, place = got
            doc = doc.view(np.int64)
            order = np.lexsort((doc, trigger, phrase))
            p, t, d = phrase[order], trigger[order], doc[order]
            first = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (t[1:] != t[:-1])]))
            keep = order[d > np.repeat(d[first], np.diff(first, append=len(d)))]
            if len(keep):
                yield blobs_by_chunk(b"R", chunk[keep], [(row[keep], 3), (place[keep], 4)])
        if (got := unpacked(rows, b"T", TRIGGER)) is not None:
            chunk, trigger, low, more, size = got
            low = low.view(np.int64)
            high = low + more.view(np.int64)
            order = np.argsort(trigger, kind="stable")
            t = trigger[order]
            first = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
            is_open = np.minimum.reduceat(low[order], first) < np.maximum.reduceat(high[order], first)
            hot = np.add.reduceat(size[order].astype(np.int64), first) > HOT
            each = np.diff(first, append=len(t))
            keep = np.repeat(is_open, each)
            if keep.any():
                yield blobs_by_chunk(b"T", chunk[order[keep]], [(t[keep], 5), (np.repeat(hot, each)[keep], 1)])


class Answers(ChunkBlobs):
    """The columns of a chunk's blobs; the last chunk's stay."""

    def __init__(self, folder: str, parts: int, kinds: dict[bytes, list[int]]) -> None:
        super().__init__(folder, parts)
        self.kinds, self.at, self.columns = kinds, None, {}

    def get(self, chunk: int, kind: bytes) -> list[np.ndarray]:
        """The columns, in the order of the first."""
        if chunk != self.at:
            blobs = self.blobs(chunk)
            self.at, self.columns = chunk, {}
            for k, widths in self.kinds.items():
                got = [unpack(b[1:], widths) for b in blobs if b[:1] == k]
                columns = [np.concatenate([g[i] for g in got]) if got else np.empty(0, U) for i in range(len(widths))]
                order = np.argsort(columns[0], kind="stable")
                self.columns[k] = [c[order].astype(np.int64) for c in columns]
        return self.columns[kind]

    def repeats(self, chunk: int, rows: np.ndarray, p: Phrases) -> np.ndarray:
        """Whether each phrase of ``p``, the parse of ``rows``, is a repeat."""
        row, place = self.get(chunk, b"R")
        out = np.zeros(len(p.doc), bool)
        starts = np.searchsorted(p.doc, np.arange(len(rows) + 1))
        text, mine = texts_of(row, rows)
        out[starts[text] + place[mine]] = True
        return out

    def open(self, chunk: int, p: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """Whether each phrase's trigger is open, and whether it is hot."""
        trigger, hot = self.get(chunk, b"T")
        if not len(trigger):
            return np.zeros(len(p.doc), bool), np.zeros(len(p.doc), bool)
        own = (p.trigger & U(LOW)).astype(np.int64)
        at = np.minimum(np.searchsorted(trigger, own), len(trigger) - 1)
        hit = trigger[at] == own
        return hit, hit & (hot[at] > 0)


def texts_of(row: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For those of ``row`` that are among ``rows``: their place there, and which they are."""
    order = np.argsort(rows)
    at = np.minimum(np.searchsorted(rows[order], row), len(rows) - 1)
    mine = rows[order][at] == row
    return order[at[mine]], np.flatnonzero(mine)


def open_phrases(n: int, folder: str, parts: int):
    """Step 3, where texts are read: phrases to be compared as bytes, by bucket, and the repeats among a task's own strings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answers = Answers(folder, parts, {b"R": REPEAT, b"T": IS_OPEN})
        held: dict[tuple[int, int], list] = {}
        strings: dict[bytes, list[tuple[int, int, int, int]]] = {}  # of hot triggers: doc_id, chunk, row, start
        size = 0

        def keep(chunk: int, trigger, doc, row, lo, k, raws: list[bytes]) -> None:
            nonlocal size
            for b, own in split_by(bucket_of(trigger, n)):
                held.setdefault((b, chunk), []).append(([x[own] for x in (trigger, doc, row, lo, k, k + LENGTH - 1)], b"".join([raws[i] for i in own.tolist()])))
            size += sum(map(len, raws))

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal size
            buckets, chunks, blobs = [], [], []
            single: dict[int, list[tuple[int, int, int, bytes]]] = {}
            known: dict[int, list[tuple[int, int]]] = {}
            for s, found in strings.items():
                least = min(found)[0]
                for doc, chunk, row, lo in found:
                    if doc > least:
                        known.setdefault(chunk, []).append((row, lo))
                    else:
                        single.setdefault(chunk, []).append((doc, row, lo, s))
            strings.clear()
            for chunk, found in single.items():
                doc, row, lo = (np.array([f[i] for f in found], np.int64) for i in range(3))
                raws = [f[3] for f in found]
                keep(chunk, np.array([xxhash.xxh64_intdigest(r) for r in raws], U), doc, row, lo, np.ones(len(raws), np.int64), raws)
            for chunk, found in known.items():
                row, lo = (np.array([f[i] for f in found], np.int64) for i in range(2))
                buckets.append(chunk % n)
                chunks.append(chunk)
                blobs.append(b"S" + pack([(row, 3), (lo, 8), (lo + LENGTH, 8)]))
            for bucket, chunk in sorted(held):
                cols = [np.concatenate([x[0][i] for x in held[bucket, chunk]]) for i in range(len(OPEN))]
                buckets.append(bucket)
                chunks.append(chunk)
                blobs.append(b"P" + pack(list(zip(cols, OPEN, strict=True))) + b"".join(x[1] for x in held[bucket, chunk]))
            held.clear()
            size = 0
            if blobs:
                yield pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), pa.array(chunks, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "chunk", "blob"])

        for batch in batches:
            for chunk, rows, docs, texts, _ in rows_of(batch):
                if not len(answers.get(chunk, b"T")[0]):
                    continue
                p = Phrases(texts)
                is_open, hot = answers.open(chunk, p)
                is_open &= ~answers.repeats(chunk, rows, p)
                cold = np.flatnonzero(is_open & ~hot)
                raws = [texts[d][s : s + m + LENGTH - 1] for d, s, m in zip(p.doc[cold].tolist(), p.lo[cold].tolist(), p.n[cold].tolist(), strict=True)]
                keep(chunk, p.trigger[cold], docs[p.doc[cold]], rows[p.doc[cold]], p.lo[cold], p.n[cold], raws)
                for i in np.flatnonzero(is_open & hot).tolist():
                    d = int(p.doc[i])
                    for at in range(int(p.lo[i]), int(p.lo[i] + p.n[i])):
                        strings.setdefault(texts[d][at : at + LENGTH], []).append((int(docs[d]), chunk, int(rows[d]), at))
                        size += 40
                if size > 16 << 20:
                    yield from flush()
        yield from flush()

    return run


def own_suffixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Step 3, the owners: the suffix array of the open phrases to a depth of LENGTH, and the strings that a smaller document has too."""
    for rows in by_bucket(batches):
        yield from passed_on(rows, b"S")
        if (got := unpacked(rows, b"P", OPEN)) is None:
            continue
        raws = [blob[9 + int.from_bytes(blob[1:9], "little") * sum(OPEN) :] for _, blob in rows if blob[:1] == b"P"]
        chunk, trigger, doc, row, lo, k, size = got
        doc, row, lo, k, size = (x.astype(np.int64) for x in (doc, row, lo, k, size))
        data = np.frombuffer(b"".join(raws) + bytes(8), np.uint8)
        starts = np.cumsum(size) - size
        order = np.argsort(trigger, kind="stable")
        cuts = [0]  # groups of whole triggers of about FLUSH strings
        total = np.cumsum(k[order])
        ends = np.append(np.flatnonzero(np.diff(trigger[order])) + 1, len(order))
        for e in ends.tolist():
            if total[e - 1] - (total[cuts[-1] - 1] if cuts[-1] else 0) >= FLUSH // 2 or e == len(order):
                cuts.append(e)
        for a, b in zip(cuts, cuts[1:], strict=False):
            own = order[a:b]
            of = np.repeat(own, k[own])
            j = np.arange(len(of)) - np.repeat(np.cumsum(k[own]) - k[own], k[own])
            at = starts[of] + j
            words = []
            for w in range(0, LENGTH, 8):
                x = np.zeros(len(at), U)
                for i in range(w, min(w + 8, LENGTH)):
                    x = x << U(8) | data[at + i].astype(U)
                words.append(x)
            suffixes = np.lexsort((doc[of], *reversed(words)))
            new = np.zeros(len(of), bool)
            new[:1] = True
            for x in words:
                s = x[suffixes]
                new[1:] |= s[1:] != s[:-1]
            d = doc[of][suffixes]
            first = np.flatnonzero(new)
            repeat = np.empty(len(of), bool)
            repeat[suffixes] = d > np.repeat(d[first], np.diff(first, append=len(d)))
            hit = np.flatnonzero(repeat)
            if len(hit):  # runs of repeated strings of one phrase
                run = np.concatenate([[True], (np.diff(hit) > 1) | (np.diff(of[hit]) != 0)])
                r = np.flatnonzero(run)
                s, e = hit[r], hit[np.append(r[1:], len(hit)) - 1]
                yield blobs_by_chunk(b"S", chunk[of[s]], [(row[of[s]], 3), (lo[of[s]] + j[s], 8), (lo[of[s]] + j[e] + LENGTH, 8)])


def merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans that overlap or touch, as one."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(end[order])
    new = np.concatenate([[True], s[1:] > e[:-1]])
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def removed_spans(answers: str, spans: str, parts: int, columns):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, more = Answers(answers, parts, {b"R": REPEAT}), Answers(spans, parts, {b"S": SPAN})
        for batch in batches:
            for chunk, rows, _, texts, s in rows_of(batch):
                doc = lo = hi = np.empty(0, np.int64)
                if len(known.get(chunk, b"R")[0]):
                    p = Phrases(texts)
                    at = np.flatnonzero(known.repeats(chunk, rows, p))
                    doc, lo, hi = p.doc[at], p.lo[at], p.lo[at] + p.n[at] - 1 + LENGTH
                row, start, end = more.get(chunk, b"S")
                text, mine = texts_of(row, rows)
                doc, lo, hi = np.append(doc, text), np.append(lo, start[mine]), np.append(hi, end[mine])
                by = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[by], np.arange(len(rows) + 1))
                found = [merged(lo[by[a:b]], hi[by[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)]
                yield batch_of(s.column(2), columns(texts, found))

    return run


def batch_of(doc_id: pa.Array, columns: list[tuple[str, pa.Array]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([doc_id, *(x for _, x in columns)], names=["doc_id", *(name for name, _ in columns)])


def span_columns(texts: list[bytes], found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, pa.Array]]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    return [("n_bytes", pa.array([len(t) for t in texts], pa.int64())), ("spans", pa.array([[{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)] for s, e in found], kind))]


def kept_bytes(text: bytes, start: np.ndarray, end: np.ndarray) -> bytes:
    at, out = 0, []
    for a, b in zip(start.tolist(), end.tolist(), strict=True):
        out.append(text[at:a])
        at = b
    return b"".join([*out, text[at:]])


def contract_columns(texts: list[bytes], found: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[str, pa.Array]]:
    return [
        ("n_bytes", pa.array([len(t) for t in texts], pa.int64())),
        ("n_removed", pa.array([int((e - s).sum()) for s, e in found], pa.int64())),
        ("n_spans", pa.array([len(s) for s, _ in found], pa.int64())),
        ("kept_sha256", pa.array([hashlib.sha256(kept_bytes(t, s, e)).hexdigest() for t, (s, e) in zip(texts, found, strict=True)], pa.string())),
    ]


def suffix_dedup(docs: DataFrame, columns=span_columns, schema: str = "n_bytes long, spans array<struct<start:long,end:long>>") -> DataFrame:
    """``doc_id`` and ``columns`` (byte spans to remove, or what is made of them) for every row of ``docs(doc_id, text)``."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows, parts = chunked(docs), n * BUCKETS
    blobs = "bucket int, chunk long, blob binary"
    with common.batch_rows(spark, 256):
        to_owner = rows.mapInArrow(to_dictionary(n * BUCKETS), blobs).repartition(n, "bucket").sortWithinPartitions("bucket")
        answers = write_by_chunk(to_owner.mapInArrow(own_dictionary, "chunk long, blob binary"), common.work_path(spark, "repeats"), n, parts)
        to_sort = rows.mapInArrow(open_phrases(n * BUCKETS, answers, parts), blobs).repartition(n, "bucket").sortWithinPartitions("bucket")
        spans = write_by_chunk(to_sort.mapInArrow(own_suffixes, "chunk long, blob binary"), common.work_path(spark, "spans"), n, parts)
    out = common.stored(rows.mapInArrow(removed_spans(answers, spans, parts, columns), f"doc_id long, {schema}"), "removed", 256)
    for path in (answers, spans):
        common.drop(spark, path)
    return out


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(common.read(spark, sf_dir, "documents"), contract_columns, "n_bytes long, n_removed long, n_spans long, kept_sha256 string")


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d)),
f AS (SELECT s, min(doc_id) AS least FROM w GROUP BY s),
c AS (SELECT doc_id, i FROM w JOIN f USING (s) WHERE least < doc_id),
g AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM c)),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY doc_id, run),
k AS (
  SELECT doc_id, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS p, a AS q FROM r
  UNION ALL SELECT d.doc_id, coalesce(max(b), 0), any_value(length(h)) // 2 FROM d LEFT JOIN r USING (doc_id) GROUP BY d.doc_id
)
SELECT d.doc_id, CAST(any_value(length(h)) // 2 AS BIGINT) AS n_bytes, CAST(any_value(length(h)) // 2 - sum(q - p) AS BIGINT) AS n_removed, count(*) - 1 AS n_spans,
  sha256(unhex(string_agg(substr(h, 2 * p + 1, 2 * (q - p)), '' ORDER BY p))) AS kept_sha256
FROM k JOIN d USING (doc_id) GROUP BY d.doc_id
"""
