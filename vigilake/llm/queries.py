"""The queries of this subpackage by name, and their SQL where SQL can express them."""

from __future__ import annotations

from . import alignment, ann, byte_bpe, chat, html_extract, language_id, lattice_lm, lexical_search, ngram_join, packing, topk, toxicity, url_filter

QUERIES = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_url_filter": url_filter.op2_url_filter,
    "op3_ann": ann.op3_ann,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_packing": packing.op5_packing,
    "op6_ngram_join": ngram_join.op6_ngram_join,
    "op7_lattice_lm": lattice_lm.op7_lattice_lm,
    "op8_topk": topk.op8_topk,
    "op9_chat": chat.op9_chat,
    "op10_language_id": language_id.op10_language_id,
    "op11_alignment": alignment.op11_alignment,
    "op12_lexical_search": lexical_search.op12_lexical_search,
    "op13_html_extract": html_extract.op13_html_extract,
}

ORACLES = {"op8_topk": topk.OP8_SQL, "op9_chat": chat.OP9_SQL, "op12_lexical_search": lexical_search.OP12_SQL}
