"""The queries of this package and their oracle SQL, by name."""

from __future__ import annotations

from . import decontamination, jaccard, kneser_ney, language, licenses, nearest, packing, pii, secret_scan, token_counts


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_packing": packing.op2_packing,
        "op3_jaccard_join": jaccard.op3_jaccard_join,
        "op4_secrets": secret_scan.op4_secrets,
        "op5_nearest": nearest.op5_nearest,
        "op6_language": language.op6_language,
        "op7_token_counts": token_counts.op7_token_counts,
        "op8_lm_scores": kneser_ney.op8_lm_scores,
        "op9_pii": pii.op9_pii,
        "op10_decontamination": decontamination.op10_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_jaccard_join": jaccard.ORACLE_SQL, "op10_decontamination": decontamination.ORACLE_SQL}
