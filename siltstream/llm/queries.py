"""The queries of this package by name, and the SQL that some of them are held against."""

from __future__ import annotations

from . import chat, decontam, jaccard, linededup, lm, pagecrf, rules, sampling, sharding, tokencount

QUERIES = {
    "op1_lm_scoring": lm.op1_lm_scoring,
    "op2_rendezvous_sharding": sharding.op2_rendezvous_sharding,
    "op3_chat_formatting": chat.op3_chat_formatting,
    "op4_line_dedup": linededup.op4_line_dedup,
    "op5_quality_rules": rules.op5_quality_rules,
    "op6_benchmark_decontamination": decontam.op6_benchmark_decontamination,
    "op7_token_counts": tokencount.op7_token_counts,
    "op8_ngram_jaccard_join": jaccard.op8_ngram_jaccard_join,
    "op9_segmentation_sampling": sampling.op9_segmentation_sampling,
    "op10_html_extraction": pagecrf.op10_html_extraction,
}

ORACLE_SQL: dict[str, str] = {
    "op2_rendezvous_sharding": sharding.OP2_SQL,
    "op3_chat_formatting": chat.OP3_SQL,
    "op4_line_dedup": linededup.OP4_SQL,
    "op8_ngram_jaccard_join": jaccard.OP8_SQL,
    "op10_html_extraction": pagecrf.OP10_SQL,
}
