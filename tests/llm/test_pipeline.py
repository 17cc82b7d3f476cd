"""The pipeline against a version in plain Python, stage by stage."""

import re

import numpy as np
import public_tokenizers as P
import pyarrow.parquet as pq
import pytest
import tiktoken

import corpus_pipeline
from tests.conftest import SF
from tests.llm.helpers import BASE, documents, links, same, sha, shingles
from tests.llm.test_content import contained
from tidegraph.llm import byte_bpe, common, toxicity


def test_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact dedup", "near copies", "decontamination", "byte BPE"]


def test_run(spark):
    docs = documents()
    score = toxicity.fit(common.read(spark, SF, "documents"), common.read(spark, SF, "labels")).scorer()
    docs = [(d, t) for d, t in docs if score([t or ""])[0] < 0.5]
    first = {}
    for d, t in sorted(docs):
        first.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t or ""), d)
    docs = [(d, t) for d, t in docs if d in set(first.values())]
    keep = {d for d, c, _ in links(docs) if d == c}
    docs = [(d, t) for d, t in docs if d in keep]
    b = pq.read_table(f"{SF}/benchmark.parquet").to_pydict()
    leaks = {r[0] for r in contained(docs, list(zip(b["item_id"], b["text"], strict=True)))}
    docs = [(d, t) for d, t in docs if d not in leaks]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=byte_bpe.load_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = [(d, len(ids := enc.encode_ordinary(t or "")), sha(" ".join(map(str, ids))), sha(t or "")) for d, t in docs]
    assert 50 < len(want) < 200 and leaks
    same(corpus_pipeline.run(spark, SF).collect(), want)


BENCH = [(1, BASE), (2, None), (3, "")]
WORDS = [f"word{i}" for i in range(100)]
#: Repeated ids with one and with different texts, null ids, nulls, empty and long texts, ties, near copies, a leak.
ODD = [(1, "copied  text here"), (2, "copied text here"), (2, "unique text of a doc_id that has a copy too"), (3, "twice"), (3, "twice"), (None, "copied text here"), (None, "only without an id"), (None, "also without an id"), (None, "also without an id")]
ODD += [(4, None), (5, ""), (None, None), (6, " ".join(WORDS)), (7, " ".join([*WORDS, "more"])), (None, " ".join([*WORDS, "else"])), (8, "before " + BASE), (None, "after " + BASE), (9, " ".join(f"long{i}" for i in range(20_000))), (6, "a second text of six")]


def kept(rows):
    """The row numbers that the stages after toxicity leave, in plain Python."""
    order = lambda i: (rows[i][0] is None, rows[i][0] or 0, i)
    best = {}
    for i in sorted(range(len(rows)), key=order):
        best.setdefault(re.sub("[\x20\x09-\x0d]+", " ", rows[i][1] or ""), i)
    stay = sorted(best.values())
    sets = {i: shingles(rows[i][1]) for i in stay}
    root = {i: i for i in stay}
    for i in stay:
        for j in stay:
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                a, b = sorted((root[i], root[j]), key=order)
                root = {k: a if r == b else r for k, r in root.items()}
    stay = [i for i in stay if root[i] == i]
    leaks = {i for i, *_ in contained([(i, rows[i][1]) for i in stay], BENCH)}
    return [i for i in stay if i not in leaks]


@pytest.mark.parametrize("rows", [ODD, []])
def test_stages_on_odd_rows(spark, tmp_path, rows):
    """Rows are dropped, not doc_ids; other columns come through, whatever their names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, row_no long, key string, tg string, node string, size string"
    spark.createDataFrame([(d, t, None, "s", None, i, "k", None, "n", "z") for i, (d, t) in enumerate(rows)], schema).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(BENCH, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = common.read(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        docs = common.stored(out, "test")
    want = kept(rows)
    assert sorted(r.row_no for r in docs.collect()) == want and (not rows or {2, 3, 6} <= set(want))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    same([(r.doc_id, r.decoded_sha256) for r in got], [(rows[i][0], sha(rows[i][1] or "")) for i in want])


def test_a_toxic_row_goes_alone(spark):
    docs = spark.createDataFrame([(1, "vile vile"), (1, "nice"), (None, "vile"), (None, "nice"), (2, None)], "doc_id long, text string")
    model = toxicity.train(["vile"] * 30 + ["nice"] * 30, np.array([1] * 30 + [0] * 30))
    same([(r.doc_id, r.text) for r in toxicity.keep_clean(docs, model).collect() if r.text], [(1, "nice"), (None, "nice")])


def test_the_session_stays_as_it_was(spark):
    before = spark.conf.get(common.BATCH_KEY)
    corpus_pipeline.drop_near_copies(spark, common.read(spark, SF, "documents"), SF).count()
    assert spark.conf.get(common.BATCH_KEY) == before


def test_stages_keep_the_columns(spark):
    docs = common.read(spark, SF, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
