"""Queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from tidewatch.llm import decontaminate, exact_dedup, filter_audit, html_extract, line_dedup, mixing, near_join, packing, quality, secrets, toxicity, url_filter, vector_codes

QUERIES = {
    "op1_toxicity": toxicity.query,
    "op2_html_extraction": html_extract.query,
    "op3_secrets": secrets.query,
    "op4_ngram_join": near_join.query,
    "op5_url_filter": url_filter.query,
    "op6_decontamination": decontaminate.query,
    "op7_line_dedup": line_dedup.query,
    "op8_exact_dedup": exact_dedup.query,
    "op9_mixing": mixing.query,
    "op10_quality": quality.query,
    "op11_filter_audit": filter_audit.query,
    "op12_vector_codes": vector_codes.query,
    "op13_packing": packing.query,
}

ORACLE_SQL = {
    "op4_ngram_join": near_join.SQL,
    "op5_url_filter": url_filter.SQL,
    "op6_decontamination": decontaminate.SQL,
    "op7_line_dedup": line_dedup.SQL,
    "op8_exact_dedup": exact_dedup.SQL,
    "op9_mixing": mixing.SQL,
    "op11_filter_audit": filter_audit.SQL,
    "op12_vector_codes": vector_codes.SQL,
}
