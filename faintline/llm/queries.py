"""The operators' registered queries: name -> (function of session and folder, SQL form or None)."""

from __future__ import annotations

from faintline.llm import conversations, language_id, licenses, line_dedup, minhash, mixing, neighbours, quality_rules, quality_svm, sentencepiece_fst, sharding, token_alignment, url_filter

QUERIES = {
    "op4_licenses": (licenses.query, None),
    "op6_sentencepiece": (sentencepiece_fst.query, None),
    "op8_neighbours": (neighbours.query, None),
    "op3_near_duplicates": (minhash.query, None),
    "op9_quality_svm": (quality_svm.query, None),
    "op1_language_id": (language_id.query, None),
    "op7_mixing": (mixing.query, None),
    "op2_sharding": (sharding.query, None),
    "op5_url_filter": (url_filter.query, url_filter.SQL),
    "op10_quality_rules": (quality_rules.query, None),
    "op11_conversations": (conversations.query, None),
    "op12_line_dedup": (line_dedup.query, line_dedup.SQL),
    "op13_token_alignment": (token_alignment.query, None),
}
