"""Queries over noise in text from scanned pages (problem 4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.llm.scanned import clean_scans
from spindle.session import table


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_scans(table(spark, sf_dir, "test4_content_list"), "p4").found


def p4_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_scans(table(spark, sf_dir, "test4_content_list"), "p4").repaired


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_found(spark, sf_dir).groupBy("noise").agg(F.count(F.lit(1)).alias("n_blocks"))


QUERIES = {"p4_found": p4_found, "p4_repaired": p4_repaired, "p4_report": p4_report}
ORACLE_SQL: dict[str, str] = {}
