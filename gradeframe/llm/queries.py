"""The queries of this package by name, and their DuckDB twins where SQL can express them."""

from __future__ import annotations

from gradeframe.llm import (
    alignment, exact_dedup, language, mixing, near_join, negatives, packing, pii, secrets, suffix_dedup,
    token_counts, token_files, topk,
)

QUERIES = {
    "op1_topk": topk.op1_topk,
    "op2_secrets": secrets.op2_secrets,
    "op3_suffix_dedup": suffix_dedup.op3_suffix_dedup,
    "op4_token_counts": token_counts.op4_token_counts,
    "op5_language": language.op5_language,
    "op6_exact_dedup": exact_dedup.op6_exact_dedup,
    "op7_mixing": mixing.op7_mixing,
    "op8_packing": packing.op8_packing,
    "op9_near_join": near_join.op9_near_join,
    "op10_pii": pii.op10_pii,
    "op11_negatives": negatives.op11_negatives,
    "op12_token_files": token_files.op12_token_files,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES = {
    "op1_topk": topk.OP1_SQL,
    "op6_exact_dedup": exact_dedup.OP6_SQL,
    "op11_negatives": negatives.OP11_SQL,
}
