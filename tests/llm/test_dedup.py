"""Exact copies, near copies and repeated strings."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.helpers import AWKWARD, BASE, SCHEMA, awkward, documents, links, repeats, same, sha
from tidegraph.llm import common, exact_dedup, ngram_join, suffix_dedup


def groups(rows):
    norm = [re.sub("[\x20\x09-\x0d]+", " ", t or "") for _, t in rows]
    out = []
    for (d, _), x in zip(rows, norm, strict=True):
        ids = [rows[j][0] for j in range(len(rows)) if norm[j] == x]
        keep = min((i for i in ids if i is not None), default=None)
        out.append((d, keep, len(ids), d == keep, sha(x)))
    return out


@pytest.mark.parametrize(("key_bits", "capacity"), [(64, 512), (64, 2), (2, 3), (1, 1)])
def test_exact(spark, key_bits, capacity):
    same(exact_dedup.exact_dedup(awkward(spark), key_bits=key_bits, capacity=capacity, capacity_bytes=4000).collect(), groups(AWKWARD))


def test_exact_of_nothing(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], SCHEMA)).collect() == []


def test_index_pages(spark):
    rows = [(i, f"text {i}") for i in range(500)]
    index = exact_dedup.Index(spark.createDataFrame(rows, SCHEMA), capacity=8)
    got = index.pages.collect()
    pages, directories = [p for p in got if p.bucket is not None], {p.owner: p for p in got if p.bucket is None}
    assert sum(len(p.key) for p in pages) == 500 and max(len(p.key) for p in pages) <= 8
    assert max(d.depth for d in directories.values()) > 0 and all(len(d.slots) == 1 << d.depth for d in directories.values())
    for p in pages:
        d = directories[p.owner]
        assert d.slots.count(p.bucket) == 1 << d.depth - p.depth
        for k in p.key:
            k %= 1 << 64
            assert k >> 64 - index.bits == p.owner and d.slots[k >> 64 - index.bits - d.depth & (1 << d.depth) - 1] == p.bucket
    asked = index.tally.unionByName(index.tally.selectExpr("key + 1 AS key", "text_sha256", "size", "keep_file", "keep_row"))
    assert {(r.text_sha256, r.keep_id, r.group_size) for r in index.find(asked).collect()} == {(sha(t), i, 1) for i, t in rows}
    index.drop()


def test_directory_doubles():
    d = exact_dedup.Directory(5, 3, 2, 10**6)
    keys = [5 << 61 | k << 50 for k in range(0, 2048, 7)]
    pages = [p for k in keys for p in d.put(k, (k, 0, 0), 1, "", b"x")] + list(d.end())
    assert d.depth > 4 and len(d.slots) == 1 << d.depth
    assert [k % (1 << 64) for p in pages[:-1] for k in p["key"]] == keys and all(len(p["key"]) <= 2 for p in pages[:-1])
    few = exact_dedup.Directory(0, 3, 1, 10**6, most=2)  # no more slots: buckets grow
    pages = [p for k in range(50) for p in few.put(k, (k, 0, 0), 1, "", b"x")] + list(few.end())
    assert len(few.slots) <= 4 and sum(len(p["key"]) for p in pages[:-1]) == 50


@pytest.mark.parametrize("hot", [1, 50_000])
def test_large_groups_are_sent_once(spark, hot):
    rows = [(i, "a  copy") for i in range(300)] + [(None, "a copy")] * 3 + [(1000 + i, f"own {i}") for i in range(40)] + [(5, "two"), (5, "two")]
    same(exact_dedup.exact_dedup(spark.createDataFrame(rows, SCHEMA).repartition(7), hot=hot).collect(), groups(rows))



class Mapped:
    """Stands for a DataFrame; mapInArrow gives the function of a task."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def test_combined_texts_go_in_small_batches():
    rows = [(i % 900, f"{i % 900} " + "x" * 10_000, 1, i, 0, i) for i in range(1000)]
    names = ["key", "norm", "size", "doc_id", "file", "row"]
    given = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[i : i + 100]]) for i in range(0, 1000, 100)]
    out = list(exact_dedup.combined(Mapped())(iter(given)))
    assert max(b.nbytes for b in out) < 2 << 20
    got = [tuple(r.values()) for b in out for r in b.to_pylist()]
    assert got == [(i, rows[i][1], i, 0, i, 2 if i < 100 else 1) for i in range(900)]
    assert list(exact_dedup.combined(Mapped())(iter([]))) == []


def test_near(spark):
    same(ngram_join.ngram_join(awkward(spark)).collect(), links(AWKWARD))
    assert ngram_join.ngram_join(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize(("docs", "members"), [(2048, 200_000), (7, 0)])
def test_near_group(spark, monkeypatch, docs, members):
    """Many texts near the threshold, in one block and in several."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", docs)
    monkeypatch.setattr(ngram_join, "MEMBERS", members)
    r = random.Random(3)
    w = [f"w{r.randrange(10**6)}" for _ in range(120)]
    rows = [(i, " ".join(x if r.random() > 0.015 else "new" + str(r.random()) for x in w)) for i in range(60)] + [(100 + i, " ".join(w)) for i in range(5)] + [(900, BASE)]
    want = links(rows)
    assert len({x[2] for x in want}) > 5
    same(ngram_join.ngram_join(spark.createDataFrame(rows, SCHEMA)).collect(), want)


def test_rows_without_ids_link(spark):
    w = [f"w{i}" for i in range(120)]
    rows = [(None, " ".join(w)), (7, " ".join([*w, "more"])), (7, "another text of one doc_id " + " ".join(w[:4])), (None, "of its own there is no other"), (None, ""), (3, None), (7, " ".join([*w, "else"]))]
    same(ngram_join.ngram_join(spark.createDataFrame(rows, SCHEMA)).collect(), links(rows))


def test_chain(spark, monkeypatch):
    """A long chain of texts, each near its neighbours only, is compared by band keys: rows sent and pairs compared stay near the number of links."""
    monkeypatch.setattr(ngram_join, "ONE_BLOCK", 20)
    monkeypatch.setattr(ngram_join, "SPREAD", 10)  # as many blocks as a chain of 400,000 texts would have
    w = [f"w{i}" for i in range(4000)]
    rows = [(i, " ".join(w[6 * i : 6 * i + 130])) for i in range(600)]
    sent = []
    real = ngram_join.deals
    monkeypatch.setattr(ngram_join, "deals", lambda *a: sent.append(common.checkpoint(real(*a))) or sent[-1])
    docs = spark.createDataFrame(rows, SCHEMA)
    got = ngram_join.ngram_join(docs).collect()
    same(got, links(rows))
    assert len({r.class_id for r in got}) == 1
    units = sent[0].groupBy("unit", "bands").count().collect()
    assert sent[0].where("bands <> -1").count() == sent[0].count() < 64 * 600
    assert sum(u["count"] * (u["count"] - 1) // 2 for u in units) < 600 * 599 / 2 / 3


def test_pruning_bound():
    for n in (32, 448):
        m = ngram_join.least_matches(n, 0.8, 1e-9)
        assert ngram_join.least_matches(n, 0.8, 0.5) > m
    r = np.random.default_rng(1)
    v = ngram_join.Verifier()
    base = np.unique(r.integers(0, 2**63, 400, dtype=np.uint64))
    other = [np.unique(np.append(base[k:], r.integers(0, 2**63, k, dtype=np.uint64))) for k in (10, 40, 44, 60, 200)]
    total, root = v.links([base, *other], np.ones(6, np.int64), None)
    jac = [len(np.intersect1d(base, o)) / len(np.union1d(base, o)) for o in other]
    assert total[0] == sum(j >= 0.8 for j in jac) and v.counts["verified"] < v.counts["pairs"]


def test_repeats(spark):
    get = lambda df: suffix_dedup.suffix_dedup(df, suffix_dedup.contract_columns, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect()
    same(get(awkward(spark)), repeats(AWKWARD))
    assert get(spark.createDataFrame([], SCHEMA)) == []
    docs = documents()
    same(get(spark.createDataFrame(docs, SCHEMA).repartition(5)), repeats(docs))


@pytest.mark.parametrize("hot", [0, 5])
def test_repeats_of_frequent_triggers(spark, monkeypatch, hot):
    """A line in many texts, with other text around it: its strings are dealt out singly."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    r = random.Random(8)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    rows = [(i, " ".join(word() for _ in range(12)) + BASE[:90] + " ".join(word() for _ in range(12))) for i in range(80)] + [(i, t) for i, t in AWKWARD]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    same(suffix_dedup.suffix_dedup(df, suffix_dedup.contract_columns, "n_bytes long, n_removed long, n_spans long, kept_sha256 string").collect(), repeats(rows))


def test_repeats_query(spark):
    from tests.conftest import SF

    same(suffix_dedup.op7_suffix_dedup(spark, SF).collect(), repeats(documents()))


def test_missing_answers_fail(tmp_path):
    with pytest.raises(FileNotFoundError):
        suffix_dedup.Answers(f"file://{tmp_path}/gone", 8, {})
    (tmp_path / "there").mkdir()
    assert not len(suffix_dedup.Answers(f"file://{tmp_path}/there", 8, {b"R": suffix_dedup.REPEAT}).get(5, b"R")[0])


def test_repeated_spans(spark):
    rows = [(1, "x" * 10 + BASE[:60] + "y"), (2, "é " + BASE[:60] + " z")]
    got = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in suffix_dedup.suffix_dedup(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {1: [], 2: [(3, 63)]}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=160), max_size=6), st.sampled_from([1, 2, 256]))
def test_parse_covers_every_string_once(texts, letters):
    texts = [bytes(b % letters for b in t) for t in texts]
    p = suffix_dedup.Phrases(texts)
    seen = [(d, lo + j) for d, lo, n in zip(p.doc.tolist(), p.lo.tolist(), p.n.tolist(), strict=True) for j in range(n)]
    assert seen == [(d, i) for d, t in enumerate(texts) for i in range(len(t) - 49)]
    string = {}
    for d, lo, n, t in zip(p.doc.tolist(), p.lo.tolist(), p.n.tolist(), p.trigger.tolist(), strict=True):
        for j in range(n):
            assert string.setdefault(texts[d][lo + j : lo + j + 50], t) == t  # a string has one trigger wherever it stands


def test_parse_of_long_texts(monkeypatch):
    text = bytes(random.Random(2).choices(range(256), k=3000))
    whole = suffix_dedup.Phrases([text])
    monkeypatch.setattr(suffix_dedup, "PART", 500)
    parts = suffix_dedup.Phrases([text, text])
    assert parts.n.sum() == 2 * whole.n.sum() == 2 * 2951
    assert set(whole.trigger.tolist()) == set(parts.trigger.tolist())


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randrange(80), r.randrange(80)) for _ in range(60)] + [(100, i) for i in range(101, 140)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)

    def root(x):
        seen, todo = {x}, [x]
        while todo:
            for y in near[todo.pop()] - seen:
                seen.add(y)
                todo.append(y)
        return min(seen)

    for limit in (0, 1000):
        got = common.components(spark.createDataFrame(edges, "u long, v long"), limit=limit).collect()
        same(got, [(x, root(x)) for x in near])
