"""The registered queries of this subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import alignment, fill_middle, hmm_lm, jaccard_join, language_id, licenses, mixing, near_vectors, quality_cnn, quality_rules, secrets, sentencepieces, token_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepieces": sentencepieces.op1_sentencepieces,
    "op2_jaccard_join": jaccard_join.op2_jaccard_join,
    "op3_token_counts": token_counts.op3_token_counts,
    "op4_secrets": secrets.op4_secrets,
    "op5_language_id": language_id.op5_language_id,
    "op6_hmm_lm": hmm_lm.op6_hmm_lm,
    "op7_quality_cnn": quality_cnn.op7_quality_cnn,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_near_vectors": near_vectors.op9_near_vectors,
    "op10_mixing": mixing.op10_mixing,
    "op11_fill_middle": fill_middle.op11_fill_middle,
    "op12_licenses": licenses.op12_licenses,
    "op13_alignment": alignment.op13_alignment,
}

ORACLES: dict[str, str] = {
    "op10_mixing": mixing.ORACLE,
    "op11_fill_middle": fill_middle.ORACLE,
}
