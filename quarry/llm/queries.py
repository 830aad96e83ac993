"""The queries of this subpackage, by name, and the SQL that they can be held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import alignment, backtrack, bpe, fingerprints, jaccard, language, licenses, manifest, packing, pii, quality, sql, substrings, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_fingerprints": fingerprints.op1_fingerprints,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_toxicity": toxicity.op3_toxicity,
        "op4_ngram_jaccard_join": jaccard.op4_ngram_jaccard_join,
        "op5_quality_rules": quality.op5_quality_rules,
        "op6_personal_data": pii.op6_personal_data,
        "op7_language_id": language.op7_language_id,
        "op8_packing": packing.op8_packing,
        "op9_byte_bpe": bpe.op9_byte_bpe,
        "op10_substring_dedup": substrings.op10_substring_dedup,
        "op11_backtracking_bpe": backtrack.op11_backtracking_bpe,
        "op12_tokenizer_alignment": alignment.op12_tokenizer_alignment,
        "op13_merkle_manifest": manifest.op13_merkle_manifest,
    }


def oracle_sql() -> dict[str, str]:
    """Where SQL can tell a query's rows; the other operators hash, tokenise, or vote by learned weights."""
    return {"op4_ngram_jaccard_join": sql.NEAR_DUPLICATES, "op10_substring_dedup": sql.REPEATED_PASSAGES, "op13_merkle_manifest": sql.MERKLE}
