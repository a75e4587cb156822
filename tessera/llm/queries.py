"""Registers the queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from tessera.llm import hostrank, langid, mixing, nearjoin, pieces, quality, records, repeats, secretscan, topk, toxicity, trie

QUERIES = {
    "op1_quality": quality.op1_quality,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_url_filter": hostrank.op3_url_filter,
    "op4_exact_topk": topk.op4_exact_topk,
    "op5_token_records": records.op5_token_records,
    "op6_source_mix": mixing.op6_source_mix,
    "op7_secrets": secretscan.op7_secrets,
    "op8_language": langid.op8_language,
    "op9_toxicity": toxicity.op9_toxicity,
    "op10_near_join": nearjoin.op10_near_join,
    "op11_prefix_trie": trie.op11_prefix_trie,
    "op12_repeats": repeats.op12_repeats,
}

SQL = {
    "op1_quality": quality.OP1_SQL,
    "op3_url_filter": hostrank.OP3_SQL,
    "op4_exact_topk": topk.OP4_SQL,
    "op10_near_join": nearjoin.OP10_SQL,
    "op11_prefix_trie": trie.OP11_SQL,
    "op12_repeats": repeats.OP12_SQL,
}
