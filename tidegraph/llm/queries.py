"""The queries and SQL of this subpackage."""

from __future__ import annotations

from . import byte_bpe, chat_format, decontaminate, exact_dedup, ngram_join, secret_scan, suffix_dedup, token_counts, token_files, toxicity

QUERIES = {
    "op1_ngram_join": ngram_join.op1_ngram_join,
    "op2_token_files": token_files.op2_token_files,
    "op3_chat_format": chat_format.op3_chat_format,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_token_counts": token_counts.op5_token_counts,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_suffix_dedup": suffix_dedup.op7_suffix_dedup,
    "op8_byte_bpe": byte_bpe.op8_byte_bpe,
    "op9_decontaminate": decontaminate.op9_decontaminate,
    "op10_secret_scan": secret_scan.op10_secret_scan,
}
SQL = {
    "op1_ngram_join": ngram_join.SQL,
    "op3_chat_format": chat_format.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op7_suffix_dedup": suffix_dedup.SQL,
    "op9_decontaminate": decontaminate.SQL,
    "op10_secret_scan": secret_scan.sql(),
}
