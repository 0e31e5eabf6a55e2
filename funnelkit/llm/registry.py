"""Queries of this subpackage and their DuckDB twins, where SQL can express them."""

from __future__ import annotations

from . import collocations, hard_negatives, jaccard, matrix_bpe, maxent, nn_descent, packing, quality, rules, secrets_scan, suffix_dedup, toxicity, wavelet

QUERIES = {
    "op1_packing": packing.op1_packing,
    "op2_wavelet": wavelet.op2_wavelet,
    "op3_matrix_bpe": matrix_bpe.op3_matrix_bpe,
    "op4_jaccard": jaccard.op4_jaccard,
    "op5_toxicity": toxicity.op5_toxicity,
    "op6_nn_descent": nn_descent.op6_nn_descent,
    "op7_rules": rules.op7_rules,
    "op8_secrets": secrets_scan.op8_secrets,
    "op9_importance": quality.op9_importance,
    "op10_maxent": maxent.op10_maxent,
    "op11_collocations": collocations.op11_collocations,
    "op12_hard_negatives": hard_negatives.op12_hard_negatives,
    "op13_suffixes": suffix_dedup.op13_suffixes,
}
ORACLE_SQL: dict[str, str] = {
    "op4_jaccard": jaccard.ORACLE_SQL,
    "op11_collocations": collocations.ORACLE_SQL,
    "op12_hard_negatives": hard_negatives.ORACLE_SQL,
    "op13_suffixes": suffix_dedup.ORACLE_SQL,
}
