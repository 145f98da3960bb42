"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from . import bpe, exact_dedup, jaccard_join, language_id, lm_scoring, mixing, quality_rules, substring_dedup, suffix_dedup, toxicity


def queries() -> dict:
    return {
        "op1_language_id": language_id.query,
        "op2_quality_rules": quality_rules.query,
        "op3_suffix_dedup": suffix_dedup.query,
        "op4_byte_bpe": bpe.query,
        "op5_lm_scoring": lm_scoring.query,
        "op6_mixing": mixing.query,
        "op7_jaccard_join": jaccard_join.query,
        "op8_exact_dedup": exact_dedup.query,
        "op9_substring_dedup": substring_dedup.query,
        "op10_toxicity": toxicity.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_quality_rules": quality_rules.SQL,
        "op5_lm_scoring": lm_scoring.SQL,
        "op6_mixing": mixing.SQL,
        "op7_jaccard_join": jaccard_join.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
        "op9_substring_dedup": substring_dedup.SQL,
    }
