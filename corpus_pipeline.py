"""The corpus pipeline: operators of tidegraph.llm as stages over ``documents``.

Each stage takes what its predecessor kept, whole, and returns the same columns, the last one the round trip's digests. Stages decide about rows, not doc_ids:
rows that share a doc_id, and rows without one, are judged each by its own text.

Defined results: null and empty texts are clean, of equal (also of all empty) texts one row stays, that of the smallest doc_id, then the first by place; texts without words are no near copies;
repeated rows are copies; texts of any length are judged whole; an empty table gives no rows; other columns, whatever their names, come through unchanged until the last stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegraph.llm import byte_bpe, common, decontaminate, exact_dedup, ngram_join, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The model is fitted on the labelled rows of ``docs`` that are not held out, then judges every row."""
    return toxicity.keep_clean(docs, toxicity.fit(docs, common.read(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.without_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class the document with the smallest doc_id stays."""
    return ngram_join.without_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.keep_clean(docs, common.read(spark, sf_dir, "benchmark"))


def bpe_round_trip(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return byte_bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("toxicity", drop_toxic), ("exact dedup", drop_copies), ("near copies", drop_near_copies), ("decontamination", drop_leaks), ("byte BPE", bpe_round_trip)]
#: Toxicity's scores are not a matter of SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = common.read(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        out = stage(spark, docs, sf_dir)
        path = common.write(out, f"stage-{name.replace(' ', '-')}")
        if last:
            common.drop(spark, last)
        docs, last = common.reread(out, path), path
    return docs
