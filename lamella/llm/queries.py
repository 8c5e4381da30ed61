"""The queries of this package, and the SQL of those that SQL can express."""

from __future__ import annotations

from lamella.llm import exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, quality_rules, secret_scan, token_counts, warc


def queries() -> dict:
    return {
        "op1_language_id": language_id.op1_language_id,
        "op2_packing": packing.op2_packing,
        "op3_token_counts": token_counts.op3_token_counts,
        "op4_quality_rules": quality_rules.op4_quality_rules,
        "op5_ngram_join": ngram_join.op5_ngram_join,
        "op6_secret_scan": secret_scan.op6_secret_scan,
        "op7_mixing": mixing.op7_mixing,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op9_line_dedup": line_dedup.op9_line_dedup,
        "op10_warc": warc.op10_warc,
        "quality_ablation": quality_rules.quality_ablation,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op4_quality_rules": quality_rules.SQL,
        "op5_ngram_join": ngram_join.SQL,
        "op8_exact_dedup": exact_dedup.SQL,
        "op9_line_dedup": line_dedup.SQL,
        "op10_warc": warc.SQL,
        "quality_ablation": quality_rules.ABLATION_SQL,
    }
