"""The subpackage's queries, and SQL for those that SQL can express."""

from __future__ import annotations

from kinlace.llm import chat_format, decontaminate, license_scan, lm_score, mixing, near_dup, quality_rules, token_lengths, token_store, toxicity

QUERIES = {
    "op1_chat_format": chat_format.op1_chat_format,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_mix_sources": mixing.op5_mix_sources,
    "op6_near_dup": near_dup.op6_near_dup,
    "op7_decontaminate": decontaminate.op7_decontaminate,
    "op8_lm_score": lm_score.op8_lm_score,
    "op9_token_lengths": token_lengths.op9_token_lengths,
    "op10_token_store": token_store.op10_token_store,
}

SQL = {
    "op1_chat_format": chat_format.op1_sql(),
    "op3_license_scan": license_scan.op3_sql(),
    "op5_mix_sources": mixing.op5_sql(),
    "op7_decontaminate": decontaminate.op7_sql(),
}
