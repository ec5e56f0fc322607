"""The opN queries and their SQL."""

from __future__ import annotations

from tidewell.llm import (
    op1_line_dedup,
    op2_toxicity,
    op3_fingerprints,
    op4_packing,
    op5_quality,
    op6_extraction,
    op7_bpe,
    op8_jaccard_join,
    op9_secrets,
    op10_neighbours,
    op11_filter_audit,
    op12_spelling,
    op13_quality_rules,
)


def _modules():
    return [
        *(op1_line_dedup, op2_toxicity, op3_fingerprints, op4_packing, op5_quality, op6_extraction, op7_bpe, op8_jaccard_join, op9_secrets),
        *(op10_neighbours, op11_filter_audit, op12_spelling, op13_quality_rules),
    ]


def queries() -> dict:
    return {m.NAME: m.query for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE for m in _modules() if getattr(m, "ORACLE", None)}
