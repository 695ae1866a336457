"""Queries of this subpackage and their SQL, as __spark_entry__.py registers them."""

from __future__ import annotations

from gradeloom.llm import balls, chat, exact_dedup, fingerprints, line_dedup, minhash, mixing, pieces, pii, quality, runs, sharding, wavelet


def queries() -> dict:
    return {
        "op1_line_dedup": line_dedup.op1_line_dedup,
        "op2_chat_formatting": chat.op2_chat_formatting,
        "op3_source_mixing": mixing.op3_source_mixing,
        "op4_minhash_near_dedup": minhash.op4_minhash_near_dedup,
        "op5_quality_classifier": quality.op5_quality_classifier,
        "op6_pii": pii.op6_pii,
        "op7_document_fingerprints": fingerprints.op7_document_fingerprints,
        "op8_exact_dedup": exact_dedup.op8_exact_dedup,
        "op10_sentencepiece": pieces.op10_sentencepiece,
        "op9_sharding": sharding.op9_sharding,
        "op11_centroid_clustering": balls.op11_centroid_clustering,
        "op12_periodic_runs": runs.op12_periodic_runs,
        "op13_token_output": wavelet.op13_token_output,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": line_dedup.OP1_SQL, "op8_exact_dedup": exact_dedup.OP8_SQL, "op2_chat_formatting": chat.OP2_SQL, "op4_minhash_near_dedup": minhash.OP4_SQL, "op11_centroid_clustering": balls.OP11_SQL}
