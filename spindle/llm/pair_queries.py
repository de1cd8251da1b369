"""Queries over broken prompt-response pairs (problem 1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from spindle.llm.pairs import broken_pairs, defect_report, evidence_report, judged_pairs
from spindle.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return broken_pairs(table(spark, sf_dir, "rejected"), "id", "question", "gold_answer", "task_type", name="p1")


def p1_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defect_report(p1_found(spark, sf_dir))


def p1_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What truncated answers are known by."""
    return evidence_report(judged_pairs(table(spark, sf_dir, "rejected"), "id", "question", "gold_answer", "task_type", name="p1"))


QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_evidence": p1_evidence}
ORACLE_SQL: dict[str, str] = {}
