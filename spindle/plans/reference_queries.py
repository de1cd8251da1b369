"""Queries over orphan references (problem 5) and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.operators.references import ParentSource, ReferenceSource, orphan_references, orphan_report
from spindle.session import table


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda name: table(spark, sf_dir, name)
    chunk_ids = F.transform("evidence", lambda e: e["chunk_id"])
    split = F.flatten(F.transform("source_ids", lambda s: F.split(F.coalesce(s, F.lit("")), "<SEP>")))
    sources = [
        ReferenceSource("evidencepack", t("evidencepack"), F.col("pack_id"), chunk_ids, "chunks"),
        ReferenceSource("rejected", t("rejected"), F.col("id"), chunk_ids, "chunks"),
        ReferenceSource("graphnode", t("graphnode"), F.col("node_id"), split, "chunks"),
        ReferenceSource("test4_content_list", t("test4_content_list"), F.col("block_id"), F.array("img_path"), "image_files"),
    ]
    parents = [
        ParentSource("chunks", t("chunks"), F.col("chunk_id"), F.col("is_deleted"), F.col("ingested_at")),
        ParentSource("image_files", t("image_files"), F.col("img_path"), F.col("is_deleted"), F.col("ingested_at")),
    ]
    return orphan_references(sources, parents)


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphan_report(p5_found(spark, sf_dir))


QUERIES = {"p5_found": p5_found, "p5_report": p5_report}

_FOUND = r"""
with norm_refs as (
  select 'evidencepack' t, pack_id rk, created_at, ingested_at, unnest(evidence).chunk_id k, 'chunks' p from evidencepack
  union all select 'rejected', id, created_at, ingested_at, unnest(evidence).chunk_id, 'chunks' from rejected
  union all select 'graphnode', cast(node_id as varchar), created_at, ingested_at, unnest(string_split(s, '<SEP>')), 'chunks'
    from (select node_id, created_at, ingested_at, unnest(source_ids) s from graphnode)
  union all select 'test4_content_list', cast(block_id as varchar), created_at, ingested_at, img_path, 'image_files' from test4_content_list),
firsts as (
  select 'evidencepack' t, pack_id rk, min(ingested_at) seen, min(created_at) made from evidencepack group by 2
  union all select 'rejected', id, min(ingested_at), min(created_at) from rejected group by 2
  union all select 'graphnode', cast(node_id as varchar), min(ingested_at), min(created_at) from graphnode group by 2
  union all select 'test4_content_list', cast(block_id as varchar), min(ingested_at), min(created_at) from test4_content_list group by 2),
refs as (
  select distinct t, rk, p, regexp_replace(replace(lower(regexp_replace(k, '^[\s\x{3000}\x{a0}\x{200b}\x{feff}]+|[\s\x{3000}\x{a0}\x{200b}\x{feff}]+$', '', 'g')), '\', '/'), '^\./', '') k from norm_refs where k is not null),
versions as (
  select 'chunks' p, chunk_id k, is_deleted d, ingested_at a from chunks
  union all select 'image_files', img_path, is_deleted, ingested_at from image_files),
parents as (
  select p, regexp_replace(replace(lower(trim(k)), '\', '/'), '^\./', '') k, min(a) first_at, arg_max(coalesce(d, false), a) gone
  from versions where k is not null group by 1, 2),
found as (
  select r.t table_name, r.rk record_key, r.k ref_key,
    case when q.k is null then 'missing' when q.gone then 'deleted' when q.first_at > f.seen then 'late' end status,
    strftime(f.made, '%Y-%m') period
  from refs r join firsts f on f.t = r.t and f.rk = r.rk left join parents q on q.p = r.p and q.k = r.k
  where r.k <> '')
"""
ORACLE_SQL = {
    "p5_found": _FOUND + "select table_name, record_key, ref_key, status, period from found where status is not null",
    "p5_report": _FOUND
    + "select table_name, period, status, count(*) n_references, count(distinct record_key) n_records from found where status is not null group by 1, 2, 3",
}
