"""The queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from tallywright.llm import language_id, line_dedup, mixing, near_dedup, packing, quality_classifier, quality_rules, ranked_search, secrets, span_dedup, topk_search, toxicity


def queries() -> dict:
    """Query name to a function of (spark, sf_dir)."""
    return {
        "op1_secret_scan": secrets.query,
        "op7_language_id": language_id.query,
        "op9_near_duplicates": near_dedup.query,
        "op8_topk_search": topk_search.query,
        "op10_mix_sources": mixing.query,
        "op2_line_dedup": line_dedup.query,
        "op3_pack_sequences": packing.query,
        "op4_quality_classifier": quality_classifier.query,
        "op5_suffix_dedup": span_dedup.query,
        "op6_quality_rules": quality_rules.query,
        "op11_toxicity": toxicity.query,
        "op12_ranked_search": ranked_search.query,
    }


def oracle_sql() -> dict[str, str]:
    """Query name to DuckDB SQL."""
    return {
        "op1_secret_scan": secrets.oracle(),
        "op6_quality_rules": quality_rules.ORACLE,
        "op2_line_dedup": line_dedup.ORACLE,
        "op8_topk_search": topk_search.ORACLE,
        "op10_mix_sources": mixing.ORACLE,
        "op12_ranked_search": ranked_search.ORACLE,
    }
