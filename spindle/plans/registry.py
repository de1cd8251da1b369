"""All queries of the core, by name, with their SQL."""

from __future__ import annotations

import importlib

MODULES = ("reference_queries", "block_queries", "graph_queries", "evaluation_queries", "more_queries", "cleanup_queries", "pack_queries", "document_queries", "source_queries")


def _gather(attribute: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out.update(getattr(importlib.import_module(f"spindle.plans.{m}"), attribute))
    return out


def queries() -> dict:
    return _gather("QUERIES")


def oracle_sql() -> dict:
    return _gather("ORACLE_SQL")
