"""All queries of the subpackage, by name, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("pair_queries", "record_queries", "scan_queries", "corpus_queries", "encoding_queries")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"spindle.llm.{m}"), attribute))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
