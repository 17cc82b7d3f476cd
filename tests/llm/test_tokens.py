"""Token files, token counts and byte BPE, against the libraries."""

import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.conftest import SF
from tests.llm.helpers import AWKWARD, SCHEMA, awkward, documents, same, sha
from tidegraph.llm import byte_bpe, token_counts, token_files

WORDS, RANKS = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.tiktoken")
TEXT = st.text(st.sampled_from("ab the'sllvre ÉéßıİΣ日́\U0001f600.,!-_0129\n\t<|endoftext>"), max_size=60)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def counter():
    return token_counts.PrefixCounter(WORDS)


@pytest.fixture(scope="module")
def replay():
    return byte_bpe.MergeReplay(byte_bpe.load_ranks(RANKS), P.PATTERN)


@pytest.fixture(scope="module")
def tik():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(RANKS), special_tokens={})


def prefix_counts(library, text):
    return [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]


def test_prefixes(counter, library):
    for _, t in AWKWARD:
        t = (t or "")[:250]
        assert token_counts.counts(counter.steps(t)).tolist() == prefix_counts(library, t)


@settings(max_examples=150, deadline=None)
@given(TEXT)
def test_random_totals(counter, library, text):
    assert int(counter.steps(text).sum(dtype=np.int64)) == len(library.encode(text, add_special_tokens=False).ids)


#: Letters that compose, that become several in lower case, marks, Hangul, other scripts' digits and white space, special strings and parts of them.
FULL = [*"ab the'sllvrd ÉéßıİΣς日本がはき゚́̂̈\U0001f600.,!-_0129½²٣\n\t\u00a0\u3000\x1c\x85>≯̸ÅΩ각", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "'re", "'ll", "ᄀ", "ᅡ", "ᆨ", "\u09c7", "\u09be", "\u0f71", "क़"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(FULL), max_size=40).map("".join))
def test_random_prefixes(counter, library, text):
    assert token_counts.counts(counter.steps(text)).tolist() == prefix_counts(library, text)


@pytest.mark.parametrize("text", ["か\u3099き\u3099く" * 60, "は\u309aか\u3099、e\u0301x1" * 40, "\u1112\u1161\u11ab\u1100\u1173\u11af" * 50, "ab か\u3099" + "a\u0302\u0323n" * 80 + " e\u0301", "e\u0301x.'s\u0301" * 50 + "a's\u0301" * 5])
def test_prefixes_of_long_decomposed_text_without_spaces(counter, library, text):
    assert token_counts.counts(counter.steps(text)).tolist() == prefix_counts(library, text)


def test_budget(counter):
    s = counter.steps("one two three four")
    assert "one two three four"[: token_counts.fits(s, 2)] == "one two "
    assert token_counts.fits(s, 0) == 0


def test_long_word(counter, library):
    w = "abcdefgh" * 100
    assert token_counts.counts(counter.steps(w))[[300, 555, 800]].tolist() == [len(library.encode(w[:i]).ids) for i in (300, 555, 800)]


@pytest.mark.parametrize("text", [" ".join(f"“word{i}” it’s" for i in range(10_000)), "日本語漢字" * 4000, " ".join(f"tie\u0302\u0301ng{i}" for i in range(10_000)), "か\u3099き" * 4000])
def test_long_texts_take_linear_time(counter, library, text):
    began = time.process_time()
    steps = counter.steps(text)
    assert time.process_time() - began < 8  # quadratic time would be minutes
    got = token_counts.counts(steps)
    assert got[-1] == len(library.encode(text, add_special_tokens=False).ids)
    for i in (5001, 9999):
        assert got[i] == len(library.encode(text[:i], add_special_tokens=False).ids)


def test_counts_table(spark, library):
    want = [(d, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for d, t in AWKWARD]
    table = token_counts.prefix_table(awkward(spark), WORDS)
    same(token_counts.totals(table, limit=100).collect(), want)
    assert all(len(r.steps) % r.step_bytes == 0 for r in table.collect())
    assert token_counts.totals(token_counts.prefix_table(spark.createDataFrame([], SCHEMA), WORDS)).collect() == []


def test_counts_query(spark, library):
    same([(r.doc_id, r.n_tokens) for r in token_counts.op5_token_counts(spark, SF).collect()], [(d, len(library.encode(t or "", add_special_tokens=False).ids)) for d, t in documents()])


# -- files


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 1000, 20_000])
@pytest.mark.parametrize("kind", ["wide", "small", "outliers", "one"])
def test_blocks(n, kind):
    r = np.random.default_rng(n)
    ids = {"wide": r.integers(0, 2**32, n, dtype=np.uint64), "small": r.integers(5, 9, n), "outliers": r.integers(0, 40, n) + (r.random(n) < 0.004) * (2**32 - 50), "one": np.full(n, 7)}[kind].astype(np.uint32)
    cuts = sorted(r.integers(0, n + 1, 5).tolist())
    arrays = np.split(ids, cuts)
    s = token_files.Shard(token_files.shard_bytes([3, None, 5, 6, 7, 8], arrays))
    assert s.doc_ids == [3, None, 5, 6, 7, 8]
    assert all((s.ids(k) == a).all() and len(s.ids(k)) == len(a) for k, a in enumerate(arrays))
    if kind == "outliers" and n >= 1000:
        assert len(s.data) < n * 2


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_encoder(library, texts):
    got = token_files.kept_encoder(WORDS).encode_batch(texts)
    assert [g.tolist() for g in got] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


def file_rows(library, rows, start=0):
    out = []
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("shard_ids", [1 << 20, 40])
def test_files(spark, library, tmp_path, shard_ids):
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    get = lambda df, to: token_files.token_files(df, f"file://{tmp_path}/{to}", WORDS, 2, token_files.contract_columns, schema, shard_ids).collect()
    same(get(awkward(spark), "a"), file_rows(library, AWKWARD))
    assert get(spark.createDataFrame([], SCHEMA), "b") == []
    assert not [p for p in (tmp_path / "a").iterdir() if p.name.startswith(".part") or not p.name.endswith((".tgids", ".crc"))]


def test_files_query(spark, library):
    same(token_files.op2_token_files(spark, SF).collect(), file_rows(library, documents()))


# -- byte BPE


@settings(max_examples=150, deadline=None)
@given(st.lists(TEXT, max_size=5))
def test_replay(replay, tik, texts):
    got = [[i for w in ws for i in w] for ws in replay.encode_batch(texts)]
    assert got == [tik.encode_ordinary(t) for t in texts]
    assert [replay.decode(g) for g in got] == [t.encode() for t in texts]


def test_replay_goes_back_for_a_lower_rank():
    """A made-up vocabulary in which a merge makes a pair of lower rank, with several places in a word."""
    ranks = {bytes([b]): b for b in range(256)} | {b"ab": 300, b"abc": 260, b"bcab": 255 + 3, b"cab": 301, b"aba": 259}
    enc = tiktoken.Encoding("odd", pat_str=r"\S+", mergeable_ranks=ranks | {f"\xff{i}".encode("latin1"): i for i in range(302) if i not in ranks.values()}, special_tokens={}, explicit_n_vocab=None)
    ranks = enc._mergeable_ranks
    m = byte_bpe.MergeReplay(ranks, r"\S+")
    r = random.Random(6)
    words = ["".join(r.choices("abc", k=r.randrange(1, 14))) for _ in range(300)]
    assert [list(t) for t in m.encode_words(words)] == [enc.encode_ordinary(w) for w in words]


def test_words_are_replayed_once(replay, tik, monkeypatch):
    """Words of several chunks meet at one owner, each replayed once; the chunks get theirs back."""
    monkeypatch.setattr(byte_bpe, "kept_replay", lambda *a: replay)
    r = random.Random(3)
    words = ["".join(r.choices("abcdefgé日", k=r.randrange(1, 12))) for _ in range(60)]
    texts = [" ".join(r.choices(words, k=40)) + "\n\n" for _ in range(12)] + ["", "x" * 5000]
    chunk = [7] * 5 + [9] * 5 + [11] * 4
    batch = pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(range(14)), pa.array(range(14)), pa.array(texts)], ["chunk", "row", "doc_id", "text"])
    sent = [(b, c, x) for got in byte_bpe.words_of_chunks(3, "", "")(iter([batch])) for b, c, x in zip(*(v.to_pylist() for v in got.columns), strict=True)]
    sent.sort(key=lambda s: s[0])
    replayed = []
    encode_words = replay.encode_words
    monkeypatch.setattr(replay, "encode_words", lambda ws: replayed.extend(ws) or encode_words(ws))
    owned = pa.RecordBatch.from_arrays([pa.array([s[i] for s in sent]) for i in range(3)], ["bucket", "chunk", "blob"])
    back = [x for got in byte_bpe.replay_owned("", "")(iter([owned])) for x in zip(*(v.to_pylist() for v in got.columns), strict=True)]
    asked = {w for t in texts for w in replay.split(t) if w.encode() not in replay.ranks}
    assert sorted(replayed) == sorted(asked)
    for c, t in zip(chunk, texts, strict=True):
        codes = byte_bpe.Codes(replay.ranks, [b for at, b in back if at == c])
        assert [int.from_bytes(x[i : i + 4], "little") for x in map(codes.__getitem__, replay.split(t)) for i in range(0, len(x), 4)] == tik.encode_ordinary(t)


def test_round_trip(spark, tik):
    want = [(d, len(ids := tik.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for d, t in AWKWARD]
    same(byte_bpe.round_trip(awkward(spark), RANKS, P.PATTERN).collect(), want)
    e = byte_bpe.encode(awkward(spark), RANKS, P.PATTERN)
    same([(r.doc_id, bytes(r.text).decode()) for r in byte_bpe.decode(e, RANKS).collect()], [(d, t or "") for d, t in AWKWARD])
    assert byte_bpe.round_trip(spark.createDataFrame([], SCHEMA), RANKS, P.PATTERN).collect() == []


def test_round_trip_query(spark, tik):
    same([(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op8_byte_bpe(spark, SF).collect()], [(d, len(ids := tik.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for d, t in documents()])
