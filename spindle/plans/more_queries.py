"""Queries over images, selections and views of the graph, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from spindle.functions.text import squeeze, suffix_of
from spindle.operators.records import latest_version
from spindle.plans.block_queries import SQUEEZE
from spindle.plans.evaluation_queries import packs, samples
from spindle.plans.graph_queries import edges, nodes
from spindle.session import table
from spindle.sources.files import SUFFIXES

MOST_BYTES = 50 * 1024 * 1024


def image_validity(spark, d):
    """Per file: standing images, those with a known suffix and size, and why others fail, the first reason that applies."""
    i = latest_version(table(spark, d, "image_files").select("img_path", "file_path", "width", "height", "n_bytes", "is_deleted", "ingested_at"), "img_path").filter(~F.coalesce("is_deleted", F.lit(False)))
    why = (
        F.when(~suffix_of(F.col("img_path")).isin(*SUFFIXES["image"]), "suffix").when(F.coalesce("n_bytes", F.lit(0)) <= 0, "empty").when(F.col("n_bytes") > MOST_BYTES, "size")
        .when((F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0), "dimensions").otherwise("valid")
    )
    return i.groupBy("file_path", why.alias("verdict")).agg(F.count(F.lit(1)).alias("n_images"))


def file_labels(spark, d):
    """Parts of file names: kind, key and ending."""
    f = table(spark, d, "test4_content_list").select("file_path").filter(F.col("file_path").isNotNull()).distinct()
    parts = F.split(F.regexp_replace("file_path", r"\.[^.]+$", ""), "[_-]+")
    return f.select("file_path", F.size(parts).alias("n_parts"), parts[0].alias("kind"), F.element_at(parts, -1).alias("ending"))


def eval_demotion(spark, d):
    """Text samples that go first where room is needed: per task those of lowest judge score, later ids first."""
    s = samples(spark, d, "modality", "task_type", "quality").filter(F.col("modality") == "text").select("id", F.trim("task_type").alias("task"), F.coalesce(F.col("quality.judge_score"), F.lit(0)).alias("judge"))
    counted = s.groupBy("task", "judge").agg(F.count(F.lit(1)).alias("n"))
    below = F.coalesce(F.sum("n").over(Window.partitionBy("task").orderBy("judge").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # only the score at the border is ranked
    border = counted.withColumn("below", below).filter(F.col("below") < 5).select(F.col("task").alias("t"), F.col("judge").alias("j"), "below")
    last = s.join(border, F.col("task").eqNullSafe(F.col("t")) & (F.col("judge") == F.col("j")))
    r = F.row_number().over(Window.partitionBy("task", "judge").orderBy(F.desc("id")))
    return last.withColumn("r", r).filter(F.col("r") + F.col("below") <= 5).select("id", "task", "judge")


def eval_coverage(spark, d):
    """Entities of packs that no sample is about."""
    p = packs(spark, d, "core_entity").select(squeeze(F.col("core_entity")).alias("entity")).filter(F.col("entity") != "").distinct()
    return p.join(samples(spark, d, "metadata").select(squeeze(F.col("metadata.core_entity")).alias("entity")), "entity", "left_anti")


def graph_view(spark, d):
    """Nodes and edges as a view shows them: number of the category, size of the symbol, width of the line within 1..6."""
    types = F.coalesce("entity_type", F.lit("Unknown"))
    n = nodes(spark, d).withColumn("category", types)
    cats = n.select("category").distinct().withColumn("number", F.row_number().over(Window.orderBy("category")) - 1)
    n = n.join(cats, "category").select(F.lit("node").alias("part"), F.col("node_id").alias("item"), F.col("number").cast("long").alias("category"), F.lit(16.0).alias("size"))
    e = edges(spark, d).select(F.lit("edge").alias("part"), F.col("edge_id").alias("item"), F.lit(None).cast("long").alias("category"), F.least(F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1.0)), F.lit(6.0)).alias("size"))
    return n.unionByName(e)


def graph_sources(spark, d):
    """Per kb and file: nodes, edges and distinct chunks that they come from."""
    from spindle.operators.graph import keys_of

    n = first(table(spark, d, "graphnode"), "node_id").select("kb_id", "file_path", F.lit(1).alias("is_node"), keys_of("source_ids").alias("keys"))
    e = first(table(spark, d, "graphedge"), "edge_id").select("kb_id", "file_path", F.lit(0).alias("is_node"), keys_of("source_ids").alias("keys"))
    both = n.unionByName(e)
    totals = both.groupBy("kb_id", "file_path").agg(F.sum("is_node").alias("n_nodes"), F.sum(1 - F.col("is_node")).alias("n_edges"))
    keys = both.select("kb_id", "file_path", F.explode("keys").alias("k")).distinct().groupBy(F.col("kb_id").alias("a"), F.col("file_path").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    same = F.col("kb_id").eqNullSafe(F.col("a")) & F.col("file_path").eqNullSafe(F.col("b"))
    return totals.join(keys, same, "left").select("kb_id", "file_path", "n_nodes", "n_edges", F.coalesce("n", F.lit(0)).alias("n_chunks"))


def first(df, key):
    from spindle.operators.records import first_version

    return first_version(df.select(key, "kb_id", "file_path", "source_ids", "ingested_at"), key)


QUERIES = {f.__name__: f for f in (image_validity, file_labels, eval_demotion, eval_coverage, graph_view, graph_sources)}

_S = "with s as (select distinct id, task_type, modality, metadata, quality from rejected)"
_KEYS = "select {0}, kb_id, file_path, trim(unnest(string_split(s, '<SEP>'))) k from (select {0}, kb_id, file_path, unnest(source_ids) s from (select distinct {0}, kb_id, file_path, source_ids from {1}))"
ORACLE_SQL = {
    "image_validity": r"""with i as (select img_path, arg_max(file_path, ingested_at) file_path, arg_max(width, ingested_at) w, arg_max(height, ingested_at) h, arg_max(n_bytes, ingested_at) b, arg_max(coalesce(is_deleted, false), ingested_at) gone from image_files group by 1)
      select file_path, case when regexp_extract(lower(img_path), '(\.[^./\\]+)$', 1) not in ('.png','.jpg','.jpeg','.bmp','.tiff','.tif','.gif','.webp') then 'suffix' when coalesce(b, 0) <= 0 then 'empty' when b > 52428800 then 'size' when coalesce(w, 0) <= 0 or coalesce(h, 0) <= 0 then 'dimensions' else 'valid' end verdict, count(*) n_images from i where not gone group by 1, 2""",
    "file_labels": r"select file_path, len(p) n_parts, p[1] kind, p[-1] ending from (select distinct file_path, regexp_split_to_array(regexp_replace(file_path, '\.[^.]+$', ''), '[_-]+') p from test4_content_list where file_path is not null)",
    "eval_demotion": _S + " select id, task, judge from (select id, trim(task_type) task, coalesce(quality.judge_score, 0) judge, row_number() over (partition by trim(task_type) order by coalesce(quality.judge_score, 0), id desc) r from s where modality = 'text') where r <= 5",
    "eval_coverage": _S + f" select distinct {SQUEEZE('core_entity')} entity from evidencepack where {SQUEEZE('core_entity')} <> '' and {SQUEEZE('core_entity')} not in (select {SQUEEZE('metadata.core_entity')} from s)",
    "graph_view": """with n as (select distinct node_id, coalesce(entity_type, 'Unknown') c from graphnode where id is not null), c as (select c, row_number() over (order by c) - 1 k from (select distinct c from n))
      select 'node' part, node_id item, k category, 16.0::double size from n join c using (c) union all select distinct 'edge', edge_id, null, least(greatest(coalesce(weight, 1.0), 1.0), 6.0) from graphedge""",
    "graph_sources": f"""with n as (select distinct node_id, kb_id, file_path from graphnode), e as (select distinct edge_id, kb_id, file_path from graphedge), b as (select kb_id, file_path, 1 a from n union all select kb_id, file_path, 0 from e),
      k as (select distinct kb_id, file_path, k from (select kb_id, file_path, k from ({_KEYS.format('node_id', 'graphnode')}) union all select kb_id, file_path, k from ({_KEYS.format('edge_id', 'graphedge')})) where k <> ''), g as (select kb_id, file_path, count(*) n from k group by 1, 2)
      select b.kb_id, b.file_path, sum(a)::bigint n_nodes, sum(1 - a)::bigint n_edges, any_value(coalesce(g.n, 0)) n_chunks from b left join g on g.kb_id is not distinct from b.kb_id and g.file_path is not distinct from b.file_path group by 1, 2""",
}
