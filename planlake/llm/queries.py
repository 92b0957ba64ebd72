"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from planlake.llm import chat_format, exact_dedup, hard_negatives, html_extract, language_id, line_dedup, merkle, near_dedup, nearest, packing, pipeline, quality, sentencepiece_codec, substring_dedup


def queries() -> dict:
    return {
        "pipeline": pipeline.run,
        "op1_minhash_near_dedup": near_dedup.op1_minhash_near_dedup,
        "op2_quality_cotraining": quality.op2_quality_cotraining,
        "op3_substring_dedup": substring_dedup.op3_substring_dedup,
        "op4_language_id": language_id.op4_language_id,
        "op5_exact_dedup": exact_dedup.op5_exact_dedup,
        "op6_chat_format": chat_format.op6_chat_format,
        "op7_sentencepiece": sentencepiece_codec.op7_sentencepiece,
        "op8_nearest_neighbours": nearest.op8_nearest_neighbours,
        "op9_best_fit_packing": packing.op9_best_fit_packing,
        "op10_line_dedup": line_dedup.op10_line_dedup,
        "op11_merkle_manifest": merkle.op11_merkle_manifest,
        "op12_hard_negatives": hard_negatives.op12_hard_negatives,
        "op13_html_extraction": html_extract.op13_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_minhash_near_dedup": near_dedup.ORACLE,
        "op3_substring_dedup": substring_dedup.ORACLE,
        "op5_exact_dedup": exact_dedup.ORACLE,
        "op6_chat_format": chat_format.ORACLE,
        "op8_nearest_neighbours": nearest.ORACLE,
        "op10_line_dedup": line_dedup.ORACLE,
        "op11_merkle_manifest": merkle.ORACLE,
        "op12_hard_negatives": hard_negatives.ORACLE,
        "op13_html_extraction": html_extract.ORACLE,
    }
