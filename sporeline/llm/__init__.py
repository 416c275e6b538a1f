"""Operators of a training-data pipeline, and the queries that apply them to whole tables."""

from __future__ import annotations

from sporeline.llm import bpe_codec, decontamination, filter_audit, language_id, license_scan, quality_rules, simhash_dedup, substring_dedup, token_alignment, token_counts, token_store, toxicity, url_filters

_MODULES = (quality_rules, bpe_codec, token_counts, token_store, simhash_dedup, substring_dedup, decontamination, language_id, toxicity, url_filters, license_scan, token_alignment, filter_audit)


def queries() -> dict:
    return {name: query for m in _MODULES for name, query in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in _MODULES for name, sql in m.ORACLES.items()}
