"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from . import chat_format, decontaminate, language_id, near_dedup, quality_classifier, quality_rules, sentencepiece_bpe, sharding, substring_dedup, token_shards

QUERIES = {
    "op1_quality_rules": quality_rules.op1_quality_rules,
    "op2_chat_formatting": chat_format.op2_chat_formatting,
    "op3_balanced_sharding": sharding.op3_balanced_sharding,
    "op4_token_shards": token_shards.op4_token_shards,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_sentencepiece": sentencepiece_bpe.op6_sentencepiece,
    "op7_benchmark_decontamination": decontaminate.op7_benchmark_decontamination,
    "op8_minhash_near_dedup": near_dedup.op8_minhash_near_dedup,
    "op9_quality_classifier": quality_classifier.op9_quality_classifier,
    "op10_language_id": language_id.op10_language_id,
}

#: Sharding by propagation, token shards, seeded encoding and the two classifiers are tested by other means.
ORACLE = {
    "op1_quality_rules": quality_rules.ORACLE,
    "op2_chat_formatting": chat_format.ORACLE,
    "op5_substring_dedup": substring_dedup.ORACLE,
    "op7_benchmark_decontamination": decontaminate.ORACLE,
    "op8_minhash_near_dedup": near_dedup.ORACLE,
}
