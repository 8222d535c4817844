"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from folio.llm import attribution, bpe, conversations, decontam, embedding_dedup, exact_dedup, ids_file, near_dedup, oracles, page_text, periodic_runs, quality, secrets, substring_dedup

QUERIES = {
    "op1_page_text": page_text.op1,
    "op2_repeated_words": substring_dedup.op2,
    "op3_near_duplicates": near_dedup.op3,
    "op4_token_attribution": attribution.op4,
    "op5_quality_ranking": quality.op5,
    "op6_bpe_round_trip": bpe.op6,
    "op7_ids_file": ids_file.op7,
    "op8_benchmark_leaks": decontam.op8,
    "op9_secret_scan": secrets.op9,
    "op10_exact_dedup": exact_dedup.op10,
    "op11_conversation_repair": conversations.op11,
    "op12_near_embeddings": embedding_dedup.op12,
    "op13_periodic_runs": periodic_runs.op13,
}

ORACLES = {
    "op2_repeated_words": oracles.OP2,
    "op3_near_duplicates": oracles.OP3,
    "op9_secret_scan": oracles.OP9,
    "op10_exact_dedup": exact_dedup.ORACLE,
    "op11_conversation_repair": oracles.OP11,
    "op12_near_embeddings": oracles.OP12,
    "op13_periodic_runs": oracles.OP13,
}
