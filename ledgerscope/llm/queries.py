"""The opN_ queries and the pipeline: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

from ledgerscope.llm import alignment, chatformat, collocations, decontaminate, licenses, mixing, neardup, pages, pii, quality, substring, topk, toxicity

QUERIES = {
    "op1_decontaminate": (decontaminate.contamination_query, decontaminate.CONTAMINATION_SQL),
    "op2_substring_dedup": (substring.substring_query, substring.SUBSTRING_SQL),
    "op3_toxicity": (toxicity.toxicity_query, None),
    "op4_chat_format": (chatformat.format_query, chatformat.FORMAT_SQL),
    "op5_quality": (quality.quality_query, None),
    "op6_near_duplicates": (neardup.neardup_query, neardup.NEARDUP_SQL),
    "op7_licenses": (licenses.license_query, licenses.LICENSE_SQL),
    "op8_pages": (pages.pages_query, pages.PAGES_SQL),
    "op9_topk": (topk.topk_query, topk.TOPK_SQL),
    "op10_mix": (mixing.mixing_query, None),
    "op11_pii": (pii.pii_query, None),
    "op12_collocations": (collocations.collocation_query, collocations.COLLOCATION_SQL),
    "op13_token_alignment": (alignment.alignment_query, None),
}


def queries():
    return {name: build for name, (build, _) in QUERIES.items()}


def oracle_sql():
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}
