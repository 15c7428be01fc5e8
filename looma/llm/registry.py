"""The queries of this package and the SQL that says what they return, where SQL can."""

from __future__ import annotations

from . import bpe, decontaminate, embed_dedup, html_extract, langid, ngram_join, pii, rp_forest, suffix_dedup, token_align, toxicity, url_filter, whiten

QUERIES = {
    "op1_pii": pii.op1_pii,
    "op2_langid": langid.op2_langid,
    "op3_bpe": bpe.op3_bpe,
    "op4_suffix_dedup": suffix_dedup.op4_suffix_dedup,
    "op5_html_extract": html_extract.op5_html_extract,
    "op6_toxicity": toxicity.op6_toxicity,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_ngram_join": ngram_join.op8_ngram_join,
    "op9_embed_dedup": embed_dedup.op9_embed_dedup,
    "op10_url_filter": url_filter.op10_url_filter,
    "op11_whiten": whiten.op11_whiten,
    "op12_rp_forest": rp_forest.op12_rp_forest,
    "op13_token_align": token_align.op13_token_align,
}

ORACLES = {
    "op10_url_filter": url_filter.oracle(),
}
