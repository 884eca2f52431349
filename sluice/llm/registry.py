"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from sluice.llm import langid, line_dedup, minhash, mixing, pieces, pii, quality_model, quality_rules, token_counts, vector_join

QUERIES = {
    "op1_embedding_near_dedup": vector_join.op1_embedding_near_dedup,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_pii": pii.op3_pii,
    "op4_mix_sources": mixing.op4_mix_sources,
    "op5_language_id": langid.op5_language_id,
    "op6_quality_classifier": quality_model.op6_quality_classifier,
    "op7_minhash_near_dedup": minhash.op7_minhash_near_dedup,
    "op8_token_counts": token_counts.op8_token_counts,
    "op9_line_dedup": line_dedup.op9_line_dedup,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}

#: SQL for DuckDB over the same tables; the others are tested against brute force, exact round trips or held-out labels.
ORACLE_SQL = {
    "op1_embedding_near_dedup": vector_join.ORACLE,
    "op4_mix_sources": mixing.ORACLE,
    "op7_minhash_near_dedup": minhash.ORACLE,
    "op9_line_dedup": line_dedup.ORACLE,
    "op10_quality_rules": quality_rules.ORACLE,
}
