"""Queries opN_<name> of this package and the SQL of those that SQL expresses."""

from __future__ import annotations

from stratawell.llm import avi, bpe, chat_views, embed_dedup, html_tree, minhash, mixing, ngram_lm, quality_cnn, toxicity

QUERIES = {
    "op1_int8_tiles": embed_dedup.op1_int8_tiles,
    "op2_counterfactual": toxicity.op2_counterfactual,
    "op3_minhash": minhash.op3_minhash,
    "op4_perspectives": chat_views.op4_perspectives,
    "op5_golden_mix": mixing.op5_golden_mix,
    "op6_bloom_lm": ngram_lm.op6_bloom_lm,
    "op7_tree_model": html_tree.op7_tree_model,
    "op8_byte_cnn": quality_cnn.op8_byte_cnn,
    "op9_avi_shots": avi.op9_avi_shots,
    "op10_bpe": bpe.op10_bpe,
}

ORACLE = {
    "op1_int8_tiles": embed_dedup.OP1_SQL,
    "op3_minhash": minhash.OP3_SQL,
    "op4_perspectives": chat_views.OP4_SQL,
    "op5_golden_mix": mixing.OP5_SQL,
}
