"""The queries of this subpackage by name, and the DuckDB SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import fingerprints, license_scan, mixing, ngram_join, packing, quality_classifier, quality_rules, substring_dedup, token_counts, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": token_counts.op1_token_counts,
    "op2_fingerprints": fingerprints.op2_fingerprints,
    "op3_license_scan": license_scan.op3_license_scan,
    "op4_substring_dedup": substring_dedup.op4_substring_dedup,
    "op5_quality_classifier": quality_classifier.op5_quality_classifier,
    "op6_packing": packing.op6_packing,
    "op7_ngram_join": ngram_join.op7_ngram_join,
    "op8_quality_rules": quality_rules.op8_quality_rules,
    "op9_mixing": mixing.op9_mixing,
    "op10_toxicity": toxicity.op10_toxicity,
}

SQL: dict[str, str] = {
    "op3_license_scan": license_scan.SQL,
    "op4_substring_dedup": substring_dedup.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op8_quality_rules": quality_rules.SQL,
}
