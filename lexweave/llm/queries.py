"""Queries of this subpackage, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from . import byte_pairs, decontamination, hard_negatives, html_text, language_id, lexical_search, near_duplicates, packing, quality_model, quality_rules, substring_dedup, token_files, toxicity


def queries() -> dict:
    return {
        "op1_token_files": token_files.op1_token_files,
        "op6_quality_model": quality_model.op6_quality_model,
        "op7_language_id": language_id.op7_language_id,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_html_text": html_text.op3_html_text,
        "op4_near_duplicates": near_duplicates.op4_near_duplicates,
        "op5_decontamination": decontamination.op5_decontamination,
        "op8_substring_dedup": substring_dedup.op8_substring_dedup,
        "op9_packing": packing.op9_packing,
        "op10_quality_rules": quality_rules.op10_quality_rules,
        "op11_hard_negatives": hard_negatives.op11_hard_negatives,
        "op12_byte_pairs": byte_pairs.op12_byte_pairs,
        "op13_lexical_search": lexical_search.op13_lexical_search,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op5_decontamination": decontamination.OP5_SQL,
        "op8_substring_dedup": substring_dedup.OP8_SQL,
        "op11_hard_negatives": hard_negatives.OP11_SQL,
        "op13_lexical_search": lexical_search.OP13_SQL,
    }
