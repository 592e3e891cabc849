"""The queries of this subpackage, by name, and their SQL where SQL can say them."""

from __future__ import annotations

from tidelog.llm import (
    boosted_quality,
    html_extraction,
    lm_scoring,
    media,
    mixing,
    ngram_join,
    packing,
    quality_rules,
    sharding,
    suffix_dedup,
)

QUERIES = {
    "op2_extendible_sharding": sharding.query,
    "op4_systematic_mixing": mixing.query,
    "op10_log_bloom_lm": lm_scoring.query,
    "op8_signature_sniffing": media.query,
    "op3_boosted_quality": boosted_quality.query,
    "op1_hilbert_packing": packing.query,
    "op9_wrapper_induction": html_extraction.query,
    "op5_prefix_tree_join": ngram_join.query,
    "op6_difference_cover_dedup": suffix_dedup.query,
    "op7_compression_bands": quality_rules.query,
}

ORACLES = {
    "op2_extendible_sharding": sharding.ORACLE_SQL,
    "op4_systematic_mixing": mixing.ORACLE_SQL,
}
