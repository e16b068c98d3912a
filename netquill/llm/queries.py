"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from . import decontamination, exact_dedup, hidden_markov, mixing, near_dedup, quality, resampling, substring_dedup, suffix_dedup, token_output, toxicity, vector_codes, warc

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_warc": warc.op2_warc,
    "op3_near_dedup": near_dedup.op3_near_dedup,
    "op4_quality": quality.op4_quality,
    "op5_mix": mixing.op5_mix,
    "op6_suffix_dedup": suffix_dedup.op6_suffix_dedup,
    "op7_substring_dedup": substring_dedup.op7_substring_dedup,
    "op8_decontamination": decontamination.op8_decontamination,
    "op9_exact_dedup": exact_dedup.op9_exact_dedup,
    "op10_tokens": token_output.op10_tokens,
    "op11_vector_codes": vector_codes.op11_vector_codes,
    "op12_resampling": resampling.op12_resampling,
    "op13_language_scores": hidden_markov.op13_language_scores,
}

ORACLE_SQL = {
    "op2_warc": warc.OP2_SQL,
    "op3_near_dedup": near_dedup.OP3_SQL,
    "op5_mix": mixing.OP5_SQL,
    "op6_suffix_dedup": suffix_dedup.OP6_SQL,
    "op7_substring_dedup": substring_dedup.OP7_SQL,
    "op9_exact_dedup": exact_dedup.OP9_SQL,
    "op11_vector_codes": vector_codes.OP11_SQL,
    "op12_resampling": resampling.OP12_SQL,
}
