"""The training-data queries and the SQL of those that SQL can express."""

from __future__ import annotations

from tidemark.llm import html, imatch, language, mixing, phrases, pieces, pii, secrets, simhash, topk, toxicity, trie, urls

QUERIES = {
    "op1_mixing": mixing.op1_mixing,
    "op2_urls": urls.op2_urls,
    "op3_imatch": imatch.op3_imatch,
    "op4_topk": topk.op4_topk,
    "op5_pii": pii.op5_pii,
    "op6_html": html.op6_html,
    "op7_simhash": simhash.op7_simhash,
    "op10_language": language.op10_language,
    "op9_toxicity": toxicity.op9_toxicity,
    "op8_sentencepiece": pieces.op8_sentencepiece,
    "op11_phrases": phrases.op11_phrases,
    "op12_secrets": secrets.op12_secrets,
    "op13_trie": trie.op13_trie,
}

ORACLE_SQL: dict[str, str] = {
    "op1_mixing": mixing.OP1_SQL,
    "op4_topk": topk.OP4_SQL,
    "op11_phrases": phrases.OP11_SQL,
    "op12_secrets": secrets.OP12_SQL,
    "op13_trie": trie.OP13_SQL,
}
