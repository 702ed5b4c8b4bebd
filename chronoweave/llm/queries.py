"""The queries of this subpackage and their SQL, by name."""

from __future__ import annotations

from chronoweave.llm import digests, drift, jaccard, katz, language, leaks, licenses, lines, merkle, mixing, passages, quality, urls

QUERIES = {
    "op1_quality_rules": quality.op1,
    "op2_url_filters": urls.op2,
    "op3_substring_dedup": passages.op3,
    "op4_ngram_jaccard_join": jaccard.op4,
    "op5_license_scans": licenses.op5,
    "op6_benchmark_decontamination": leaks.op6,
    "op7_lm_scoring": katz.op7,
    "op8_language_id": language.op8,
    "op9_line_dedup": lines.op9,
    "op10_mixing_sources": mixing.op10,
    "op11_drifted_schema_rewrite": drift.op11,
    "op12_merkle_manifest": merkle.op12,
    "op13_document_fingerprints": digests.op13,
}
#: The others hold models or hashes that SQL can't express; tests/llm holds them against brute force.
ORACLE_SQL = {
    "op1_quality_rules": quality.OP1_SQL,
    "op4_ngram_jaccard_join": jaccard.OP4_SQL,
    "op5_license_scans": licenses.OP5_SQL,
    "op9_line_dedup": lines.OP9_SQL,
    "op10_mixing_sources": mixing.OP10_SQL,
}
