"""Queries of this package by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from . import decontam, lm, neardup, packing, pages, pii, quality_rules, repair, secrets, sharding

QUERIES = {
    "op1_quality_rules": quality_rules.op1,
    "op2_lm_scores": lm.op2,
    "op3_page_text": pages.op3,
    "op4_secrets": secrets.op4,
    "op5_minhash_neardup": neardup.op5,
    "op6_decontamination": decontam.op6,
    "op7_repair_tokens": repair.op7,
    "op8_harmonic_packing": packing.op8,
    "op9_kd_sharding": sharding.op9,
    "op10_pii": pii.op10,
}
ORACLES: dict[str, str] = {}
