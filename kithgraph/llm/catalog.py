"""Queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

from kithgraph.llm import (
    decontaminate,
    html_extract,
    line_dedup,
    mixing,
    near_dedup,
    quality,
    quality_network,
    ranked_search,
    substring_dedup,
    token_alignment,
    token_files,
    toxicity,
    url_filter,
)

QUERIES = {
    "op1_line_dedup": line_dedup.op1_line_dedup,
    "op2_quality_rules": quality.op2_quality_rules,
    "op3_url_filter": url_filter.op3_url_filter,
    "op4_near_dedup": near_dedup.op4_near_dedup,
    "op5_token_files": token_files.op5_token_files,
    "op6_mix_sources": mixing.op6_mix_sources,
    "op7_html_extract": html_extract.op7_html_extract,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_substring_dedup": substring_dedup.op10_substring_dedup,
    "op11_ranked_search": ranked_search.op11_ranked_search,
    "op12_token_alignment": token_alignment.op12_token_alignment,
    "op13_quality_classifier": quality_network.op13_quality_classifier,
}
ORACLES = {
    "op1_line_dedup": line_dedup.SQL,
    "op3_url_filter": url_filter.SQL,
    "op6_mix_sources": mixing.SQL,
    "op8_decontaminate": decontaminate.SQL,
    "op11_ranked_search": ranked_search.SQL,
}
