"""The subpackage's queries and their SQL."""

from __future__ import annotations

from quillspark.llm import decontaminate, exact_dedup, license_scan, line_dedup, lm_score, near_dedup, packing, quality, token_files, toxicity

MODULES = (exact_dedup, license_scan, line_dedup, decontaminate, token_files, packing, near_dedup, lm_score, toxicity, quality)


def queries() -> dict:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
