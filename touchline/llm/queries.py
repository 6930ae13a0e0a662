"""The subpackage's queries and their SQL."""

from __future__ import annotations

from . import decontamination, fixity, language, neighbours, packing, quality, secrets, simhash, substring, token_counts


def queries() -> dict:
    return {
        "op1_decontamination": decontamination.op1_decontamination,
        "op2_fixity": fixity.op2_fixity,
        "op3_simhash": simhash.op3_simhash,
        "op4_packing": packing.op4_packing,
        "op5_language": language.op5_language,
        "op6_substring": substring.op6_substring,
        "op7_neighbours": neighbours.op7_neighbours,
        "op8_quality": quality.op8_quality,
        "op9_token_counts": token_counts.op9_token_counts,
        "op10_secrets": secrets.op10_secrets,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.ORACLE, "op2_fixity": fixity.ORACLE, "op6_substring": substring.ORACLE}
