"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from glyphloom.llm import bpe, exact_dedup, html_extract, license_scan, mixing, near_dedup, pii, quality_classifier, quality_rules, secret_scan

QUERIES = {
    "op1_html_extract": html_extract.op1_html_extract,
    "op2_minhash_near_dedup": near_dedup.op2_minhash_near_dedup,
    "op3_mixing": mixing.op3_mixing,
    "op4_secret_scan": secret_scan.op4_secret_scan,
    "op5_exact_dedup": exact_dedup.op5_exact_dedup,
    "op6_license_scan": license_scan.op6_license_scan,
    "op7_quality_classifier": quality_classifier.op7_quality_classifier,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_pii": pii.op9_pii,
    "op10_quality_rules": quality_rules.op10_quality_rules,
}
SQL = {"op2_minhash_near_dedup": near_dedup.OP2_SQL, "op5_exact_dedup": exact_dedup.OP5_SQL}
