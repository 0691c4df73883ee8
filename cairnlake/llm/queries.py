"""The queries of this subpackage: one for each operator, over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from cairnlake.llm import bpe, codes, exact_dedup, langid, mixing, negatives, pieces, pii, quality, simhash, tokencount, tokenfiles, toxicity


def queries() -> dict:
    return {
        "op1_token_files": tokenfiles.op1_token_files,
        "op2_mixing": mixing.op2_mixing,
        "op3_token_counts": tokencount.op3_token_counts,
        "op4_simhash": simhash.op4_simhash,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_bpe": bpe.op6_bpe,
        "op7_pii": pii.op7_pii,
        "op8_toxicity": toxicity.op8_toxicity,
        "op9_language_id": langid.op9_language_id,
        "op10_exact_dedup": exact_dedup.op10_exact_dedup,
        "op11_hard_negatives": negatives.op11_hard_negatives,
        "op12_vector_codes": codes.op12_vector_codes,
        "op13_sentencepiece": pieces.op13_sentencepiece,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op10_exact_dedup": exact_dedup.SQL,
        "op11_hard_negatives": negatives.SQL,
        "op12_vector_codes": codes.SQL,
    }
