"""Queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from procmetrics.llm import byte_bpe, exact_dedup, fill_middle, language_id, merkle, ngram_lm, packing, secrets, sharding, simhash, token_store, topk, toxicity

QUERIES = {
    "op1_secrets": secrets.op1_secrets,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_token_store": token_store.op3_token_store,
    "op4_topk": topk.op4_topk,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_language_id": language_id.op6_language_id,
    "op7_simhash": simhash.op7_simhash,
    "op8_ngram_lm": ngram_lm.op8_ngram_lm,
    "op9_packing": packing.op9_packing,
    "op10_byte_bpe": byte_bpe.op10_byte_bpe,
    "op11_sharding": sharding.op11_sharding,
    "op12_merkle_manifest": merkle.op12_merkle_manifest,
    "op13_fill_middle": fill_middle.op13_fill_middle,
}

ORACLE = {
    "op1_secrets": secrets.ORACLE,
    "op4_topk": topk.ORACLE,
    "op5_exact_dedup": exact_dedup.ORACLE,
    "op11_sharding": sharding.ORACLE,
    "op12_merkle_manifest": merkle.ORACLE,
    "op13_fill_middle": fill_middle.ORACLE,
}
