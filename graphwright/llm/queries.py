"""Queries op1 to op10 and the pipeline, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, crf_quality, embedding_dedup, line_dedup, mixing, ngram_join, quality_rules, sharding, warc

QUERIES = {
    "op1_source_mixing": mixing.query,
    "op2_line_dedup": line_dedup.query,
    "op3_warc": warc.query,
    "op4_chat_formatting": chat.query,
    "op5_sharding": sharding.query,
    "op6_quality_rules": quality_rules.query,
    "op7_ngram_jaccard": ngram_join.query,
    "op8_embedding_dedup": embedding_dedup.query,
    "op9_byte_bpe": bpe.query,
    "op10_crf_quality": crf_quality.query,
}
ORACLES = {"op1_source_mixing": mixing.SQL, "op2_line_dedup": line_dedup.SQL, "op3_warc": warc.SQL, "op4_chat_formatting": chat.SQL, "op5_sharding": sharding.SQL, "op6_quality_rules": quality_rules.SQL, "op7_ngram_jaccard": ngram_join.SQL, "op8_embedding_dedup": embedding_dedup.SQL}
