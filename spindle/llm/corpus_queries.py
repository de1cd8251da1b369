"""Queries over the encoded corpus (problem 6) and packed containers (problem 7)."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.llm.bpe import TOKENIZERS_DIR, ByteBPE, encode
from spindle.llm.packing import fill_report, pack_documents, recall
from spindle.session import table

#: Specs are read by the driver; more than this is an error.
MOST_SPECS = 1000


@lru_cache(maxsize=2)
def tokenizer(name: str = "byte_bpe_50k", directory: str = TOKENIZERS_DIR) -> ByteBPE:
    return ByteBPE(name, directory)


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer())


def p6_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens per language: documents, tokens, and the longest text."""
    ids = p6_ids(spark, sf_dir).select("doc_id", F.size("ids").cast("long").alias("n_tokens"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    return docs.join(ids, "doc_id").groupBy("lang").agg(
        F.count(F.lit(1)).alias("n_documents"), F.sum("n_tokens").alias("n_tokens"), F.max("n_tokens").alias("longest")
    )


def _specs(spark: SparkSession, sf_dir: str) -> dict[int, int]:
    rows = table(spark, sf_dir, "pack_specs").select("spec_id", "capacity_tokens").limit(MOST_SPECS + 1).collect()
    if len(rows) > MOST_SPECS:
        raise ValueError(f"more than {MOST_SPECS} specs")
    return {r[0]: r[1] for r in rows if r[0] is not None and r[1] is not None}


def p7_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), "doc_id", "text", _specs(spark, sf_dir), tokenizer(), "p7")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_report(p7_assignments(spark, sf_dir), _specs(spark, sf_dir))


def p7_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the nearest items of a text lie in its own shard of the index."""
    return recall(table(spark, sf_dir, "documents"), "doc_id", "text", tokenizer(), name="p7")


QUERIES = {"p6_ids": p6_ids, "p6_lengths": p6_lengths, "p7_assignments": p7_assignments, "p7_report": p7_report, "p7_recall": p7_recall}
ORACLE_SQL: dict[str, str] = {}
