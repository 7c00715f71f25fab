"""The queries of this subpackage and their DuckDB twins, by name."""

from __future__ import annotations

from leaksieve.llm import (
    byte_bpe,
    decontamination,
    exact_dedup,
    filter_audit,
    html_text,
    importance,
    language_id,
    line_dedup,
    packing,
    simhash_dedup,
    substring_dedup,
    tool_calls,
    url_filter,
)

#: name: (query, SQL that gives the same rows, or None where SQL cannot express it).
QUERIES = {
    "op1_tool_calls": (tool_calls.op1_tool_calls, None),
    "op2_simhash_dedup": (simhash_dedup.op2_simhash_dedup, None),
    "op3_html_extraction": (html_text.op3_html_extraction, None),
    "op4_substring_dedup": (substring_dedup.op4_substring_dedup, substring_dedup.ORACLE),
    "op5_line_dedup": (line_dedup.op5_line_dedup, line_dedup.ORACLE),
    "op6_url_filters": (url_filter.op6_url_filters, None),
    "op7_exact_dedup": (exact_dedup.op7_exact_dedup, exact_dedup.ORACLE),
    "op8_benchmark_decontamination": (decontamination.op8_benchmark_decontamination, decontamination.ORACLE),
    "op9_language_id": (language_id.op9_language_id, None),
    "op10_best_fit_packing": (packing.op10_best_fit_packing, None),
    "op11_importance_resampling": (importance.op11_importance_resampling, importance.ORACLE),
    "op12_filter_audit": (filter_audit.op12_filter_audit, filter_audit.ORACLE),
    "op13_byte_bpe": (byte_bpe.op13_byte_bpe, None),
}
