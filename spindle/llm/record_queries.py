"""Queries over samples by target proportions (problem 2) and canonical values (problem 3)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.llm.canonical import map_to_canonical
from spindle.llm.sampling import Source, TargetSample, deficits, sample_by_targets
from spindle.session import table


def _sampled(spark: SparkSession, sf_dir: str) -> TargetSample:
    sources = [
        Source("rejected", table(spark, sf_dir, "rejected"), "id", ["task_type", "modality"]),
        Source("evidencepack", table(spark, sf_dir, "evidencepack"), "pack_id", ["core_entity"]),
    ]
    return sample_by_targets(sources, table(spark, sf_dir, "sample_targets"), name="p2")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deficits(_sampled(spark, sf_dir).report)


def p2_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).report


def p2_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sampled(spark, sf_dir).sample


def _typed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Records with freely typed values that are cases, the mapping of their distinct values, and the entries."""
    nodes = table(spark, sf_dir, "graphnode").select(F.lit("entity_type").alias("kind"), F.col("node_id").alias("record_id"), F.col("entity_type").alias("value"))
    edges = table(spark, sf_dir, "graphedge").select(F.lit("relation_type").alias("kind"), F.col("edge_id").alias("record_id"), F.col("relation_type").alias("value"))
    entries = table(spark, sf_dir, "canonical_types")
    exact = entries.select("kind", F.col("name").alias("value"))
    blank = F.length(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")) == 0
    cases = nodes.unionByName(edges).filter(F.col("value").isNotNull() & ~blank).join(exact, ["kind", "value"], "left_anti").distinct()
    names = F.concat(F.array("name", "name_en"), F.coalesce("other_names", F.array().cast("array<string>")))
    mapping = map_to_canonical(cases, entries.select("canonical_id", "kind", names.alias("names")))
    return cases, mapping, entries


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases, mapping, _ = _typed(spark, sf_dir)
    return cases.join(mapping, ["kind", "value"]).select("kind", "record_id", "canonical_id")


def p3_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values that mean no entry, with the number of their records."""
    cases, mapping, _ = _typed(spark, sf_dir)
    none = mapping.filter(F.col("canonical_id") == 0).select("kind", "value")
    return cases.join(none, ["kind", "value"]).groupBy("kind", "value").agg(F.countDistinct("record_id").alias("n_records"))


QUERIES = {"p2_found": p2_found, "p2_report": p2_report, "p2_sample": p2_sample, "p3_found": p3_found, "p3_unmatched": p3_unmatched}

_QUOTAS = r"""
with recs as (
  select 'rejected' source_table, id k, any_value(regexp_replace(task_type, '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g')) a,
    any_value(regexp_replace(modality, '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g')) b from rejected group by id
  union all
  select 'evidencepack', pack_id, any_value(regexp_replace(core_entity, '^[\s\x{3000}\x{a0}]+|[\s\x{3000}\x{a0}]+$', '', 'g')), '' from evidencepack group by pack_id),
n as (select source_table, count(*) n from recs group by 1),
q as (
  select t.source_table, t.target_id, n.n n_records,
    (select count(*) from recs r where r.source_table = t.source_table and r.a = coalesce(t.task_type, t.core_entity) and r.b = coalesce(t.modality, '')) observed,
    greatest(t.min_rows, (t.target_permille * ((t.sample_permille * n.n) // 1000)) // 1000) quota
  from sample_targets t join n on n.source_table = t.source_table)
"""
ORACLE_SQL = {
    "p2_found": _QUOTAS + "select target_id from q where observed < quota",
    "p2_sample": _QUOTAS + """, r as (select q.source_table, q.target_id, k record_key, quota, (('0x' || md5(k || '|' || q.target_id || '|17')[1:13])::bigint)::double / 4503599627370496.0 u from q join sample_targets t using (target_id) join recs r on r.source_table = q.source_table and r.a = coalesce(t.task_type, t.core_entity) and r.b = coalesce(t.modality, ''))
      select source_table, target_id, record_key from (select *, row_number() over (partition by target_id order by u, record_key) n from r) where n <= quota""",
    "p2_report": _QUOTAS + "select source_table, target_id, n_records, observed, quota, least(observed, quota) sampled, quota - least(observed, quota) deficit from q",
}
