"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from tokenloom.llm import chat, decontam, lines, lm, mixing, neardup, pii, quality, secrets, tokens

MODULES = {
    "op1_chat_windows": chat,
    "op2_separator_scan": tokens,
    "op3_deleted_interpolation": lm,
    "op4_line_frequency": lines,
    "op5_pii_weak_supervision": pii,
    "op6_soft_mixing": mixing,
    "op7_randomness_battery": secrets,
    "op8_quality_ftrl": quality,
    "op9_chosen_path_join": neardup,
    "op10_decontam_suffix_array": decontam,
}


def queries() -> dict:
    return {name: m.query for name, m in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: m.ORACLE for name, m in MODULES.items() if getattr(m, "ORACLE", None)}
