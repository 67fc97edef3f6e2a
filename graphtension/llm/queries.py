"""Queries of this subpackage and their DuckDB text; each applies its operator to its whole table."""

from __future__ import annotations

from graphtension.llm import chat, jaccard, language, mixing, neardup_vectors, packing, substrings, topk, toxicity, urls

QUERIES = {
    "op1_language_id": language.op1_language_id,
    "op2_chat_format": chat.op2_chat_format,
    "op3_toxicity": toxicity.op3_toxicity,
    "op4_jaccard_join": jaccard.op4_jaccard_join,
    "op5_packing": packing.op5_packing,
    "op6_substring_dedup": substrings.op6_substring_dedup,
    "op7_topk": topk.op7_topk,
    "op8_vector_neardup": neardup_vectors.op8_vector_neardup,
    "op9_mixing": mixing.op9_mixing,
    "op10_url_filters": urls.op10_url_filters,
}

ORACLE = {"op9_mixing": mixing.ORACLE, "op10_url_filters": urls.ORACLE}
