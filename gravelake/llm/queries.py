"""Queries over the corpus operators, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from gravelake.llm import fingerprints, langid, lm, ngram_join, packing, pu_quality, quality, sharding, spm, toxicity, url_filters, whitening

QUERIES = {
    "op1_sharding": sharding.op1_sharding,
    "op2_toxicity": toxicity.op2_toxicity,
    "op3_ngram_join": ngram_join.op3_ngram_join,
    "op4_language": langid.op4_language,
    "op5_url_filters": url_filters.op5_url_filters,
    "op6_quality": quality.op6_quality,
    "op7_lm_scoring": lm.op7_lm_scoring,
    "op8_fingerprints": fingerprints.op8_fingerprints,
    "op9_sentencepiece": spm.op9_sentencepiece,
    "op10_packing": packing.op10_packing,
    "op11_quality_classifier": pu_quality.op11_quality_classifier,
    "op12_whitening": whitening.op12_whitening,
}


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": sharding.oracle(), "op3_ngram_join": ngram_join.oracle(), "op5_url_filters": url_filters.oracle(), "op8_fingerprints": fingerprints.oracle()}
