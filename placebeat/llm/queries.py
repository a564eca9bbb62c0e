"""The subpackage's queries and the SQL they are compared with."""

from __future__ import annotations

from placebeat.llm import (
    centroid_clustering, decontamination, document_fingerprints, html_extraction, license_scans, merkle_manifest, mixing, near_duplicates, quality_rules, repeated_passages,
    secret_scans, token_counts, url_filters,
)

QUERIES = {
    "op1_html_extraction": html_extraction.op1_html_extraction,
    "op2_quality_rules": quality_rules.op2_quality_rules,
    "op3_near_duplicates": near_duplicates.op3_near_duplicates,
    "op4_secret_scans": secret_scans.op4_secret_scans,
    "op5_mixing": mixing.op5_mixing,
    "op6_token_counts": token_counts.op6_token_counts,
    "op7_license_scans": license_scans.op7_license_scans,
    "op8_url_filters": url_filters.op8_url_filters,
    "op9_decontamination": decontamination.op9_decontamination,
    "op10_repeated_passages": repeated_passages.op10_repeated_passages,
    "op11_merkle_manifest": merkle_manifest.op11_merkle_manifest,
    "op12_document_fingerprints": document_fingerprints.op12_document_fingerprints,
    "op13_centroid_clustering": centroid_clustering.op13_centroid_clustering,
}

ORACLES = {
    "op5_mixing": mixing.mixing_sql(),
    "op7_license_scans": license_scans.license_sql(),
    "op11_merkle_manifest": merkle_manifest.manifest_sql(),
    "op13_centroid_clustering": centroid_clustering.clustering_sql(),
}
