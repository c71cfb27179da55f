"""The registered queries of the text operators and the SQL that checks those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from alertweave.llm import bpe, exact_dedup, hard_negatives, licenses, merkle, minhash_dedup, packing
from alertweave.llm import quality_classifier, quality_rules, substring_dedup, suffix_tree_lm, whitening, wrappers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_license_scan": licenses.op1_license_scan,
    "op2_wrapper_extraction": wrappers.op2_wrapper_extraction,
    "op3_suffix_tree_lm": suffix_tree_lm.op3_suffix_tree_lm,
    "op4_merkle_fingerprints": merkle.op4_merkle_fingerprints,
    "op5_substring_dedup": substring_dedup.op5_substring_dedup,
    "op6_best_fit_packing": packing.op6_best_fit_packing,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_minhash_dedup": minhash_dedup.op8_minhash_dedup,
    "op9_quality_rules": quality_rules.op9_quality_rules,
    "op10_byte_bpe": bpe.op10_byte_bpe,
    "op11_embedding_whitening": whitening.op11_embedding_whitening,
    "op12_exact_dedup": exact_dedup.op12_exact_dedup,
    "op13_hard_negatives": hard_negatives.op13_hard_negatives,
}

ORACLE: dict[str, str] = {
    "op5_substring_dedup": substring_dedup.OP5_SQL,
    "op12_exact_dedup": exact_dedup.OP12_SQL,
    "op13_hard_negatives": hard_negatives.OP13_SQL,
}
