"""The queries of this subpackage and their DuckDB equivalents."""

from __future__ import annotations

from depsift.llm import exact_dedup, html_extract, line_dedup, ngram_join, packing, quality_rules, repeats, source_mix, token_files, toxicity

_MODULES = {
    "op1_source_mix": source_mix,
    "op2_suffix_array_dedup": repeats,
    "op3_exact_dedup": exact_dedup,
    "op4_toxicity": toxicity,
    "op5_quality_rules": quality_rules,
    "op6_line_dedup": line_dedup,
    "op7_token_files": token_files,
    "op8_best_fit_packing": packing,
    "op9_html_extract": html_extract,
    "op10_ngram_jaccard_join": ngram_join,
}
QUERIES = {name: module.query for name, module in _MODULES.items()}
SQL = {name: module.SQL for name, module in _MODULES.items() if module.SQL}
