"""The corpus queries and their SQL."""

from __future__ import annotations

from . import chat_format, decontaminate, hard_negatives, html_extract, jaccard_join, lang_id, lexical_search, line_dedup, media, mixing, toxicity, url_filter, winnowing

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_html_extract": html_extract.op2_html_extract,
    "op3_media": media.op3_media,
    "op4_url_filter": url_filter.op4_url_filter,
    "op5_mixing": mixing.op5_mixing,
    "op6_line_dedup": line_dedup.op6_line_dedup,
    "op7_jaccard_join": jaccard_join.op7_jaccard_join,
    "op8_toxicity": toxicity.op8_toxicity,
    "op9_lang_id": lang_id.op9_lang_id,
    "op10_chat_format": chat_format.op10_chat_format,
    "op11_hard_negatives": hard_negatives.op11_hard_negatives,
    "op12_winnowing": winnowing.op12_winnowing,
    "op13_lexical_search": lexical_search.op13_lexical_search,
}
SQL = {"op6_line_dedup": line_dedup.SQL, "op10_chat_format": chat_format.SQL, "op11_hard_negatives": hard_negatives.SQL, "op12_winnowing": winnowing.SQL, "op13_lexical_search": lexical_search.SQL}
