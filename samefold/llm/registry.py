"""The queries of this subpackage and their SQL twins."""

from __future__ import annotations

from samefold.llm import decontaminate, langid, licenses, linededup, neardup, packing, quality, secrets, suffixdedup, toxicity


def queries() -> dict:
    return {
        "op1_secret_scan": secrets.query,
        "op10_suffix_dedup": suffixdedup.query,
        "op2_ngram_join": neardup.query,
        "op3_best_fit_packing": packing.query,
        "op4_quality_rules": quality.query,
        "op5_license_scan": licenses.query,
        "op6_decontaminate": decontaminate.query,
        "op7_language_id": langid.query,
        "op8_line_dedup": linededup.query,
        "op9_toxicity": toxicity.query,
        "quality_ablation": quality.ablation_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_suffix_dedup": suffixdedup.SQL,
        "op2_ngram_join": neardup.SQL,
        "op4_quality_rules": quality.SQL,
        "op5_license_scan": licenses.SQL,
        "op6_decontaminate": decontaminate.SQL,
        "op8_line_dedup": linededup.SQL,
        "quality_ablation": quality.ABLATION_SQL,
    }
