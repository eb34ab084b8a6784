"""All queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

import corpus_pipeline

from . import ann, html_extraction, license_scan, lm_scoring, mixing, near_dedup, packing, quality_classifier, quality_rules, resampling, secret_scan, substring_dedup, vector_codes

MODULES = (quality_rules, license_scan, quality_classifier, ann, packing, mixing, substring_dedup, secret_scan, near_dedup, lm_scoring, resampling, html_extraction, vector_codes)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()} | {"pipeline": corpus_pipeline.run}


def oracle_sql() -> dict:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
