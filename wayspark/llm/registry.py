"""The queries of this subpackage and their SQL."""

from __future__ import annotations

import importlib

MODULES = ("warc", "mixing", "multiset_hash", "importance", "line_dedup", "byte_bpe", "language_id", "quality_rules", "simhash", "url_filter", "html_extraction", "hard_negatives", "conversation_repair")


def _modules():
    return [importlib.import_module(f"wayspark.llm.{name}") for name in MODULES]


def queries() -> dict:
    return {k: f for m in _modules() for k, f in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: s for m in _modules() for k, s in m.ORACLE_SQL.items()}
