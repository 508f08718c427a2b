"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, html_text, line_dedup, mixing, pii, simhash, substring_dedup, token_files, toxicity

QUERIES = {
    "op1_html_text": html_text.op1_html_text,
    "op2_substring_dedup": substring_dedup.op2_substring_dedup,
    "op3_benchmark_decontamination": decontamination.op3_benchmark_decontamination,
    "op4_token_files": token_files.op4_token_files,
    "op5_source_mixing": mixing.op5_source_mixing,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_line_dedup": line_dedup.op7_line_dedup,
    "op8_personal_data": pii.op8_personal_data,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_simhash_near_dedup": simhash.op10_simhash_near_dedup,
}

ORACLES = {**exact_dedup.ORACLE_SQL, **line_dedup.ORACLE_SQL, **mixing.ORACLE_SQL, **substring_dedup.ORACLE_SQL}
