"""The queries of the numbered operators, and SQL where SQL can express them."""

from __future__ import annotations

from . import chat, collocations, decontaminate, embed_dedup, jaccard, mixing, periodic, pii, quality, sharding, substring, token_binary, toxicity

QUERIES = {
    "op1_decontaminate": decontaminate.op1_decontaminate,
    "op2_pii": pii.op2_pii,
    "op3_mix_sources": mixing.op3_mix_sources,
    "op4_chat_format": chat.op4_chat_format,
    "op5_embed_dedup": embed_dedup.op5_embed_dedup,
    "op6_token_binary": token_binary.op6_token_binary,
    "op7_ngram_jaccard": jaccard.op7_ngram_jaccard,
    "op8_quality": quality.op8_quality,
    "op9_substring_dedup": substring.op9_substring_dedup,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_collocations": collocations.op11_collocations,
    "op12_periodic_runs": periodic.op12_periodic_runs,
    "op13_shards": sharding.op13_shards,
}

ORACLE_SQL = {
    "op1_decontaminate": decontaminate.OP1_SQL,
    "op3_mix_sources": mixing.OP3_SQL,
    "op4_chat_format": chat.OP4_SQL,
    "op5_embed_dedup": embed_dedup.OP5_SQL,
    "op7_ngram_jaccard": jaccard.OP7_SQL,
    "op9_substring_dedup": substring.OP9_SQL,
    "op11_collocations": collocations.OP11_SQL,
}
