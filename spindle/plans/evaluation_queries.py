"""Queries over evaluation data and events, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.functions.udfs import first_json_object
from spindle.functions.text import squeeze
from spindle.operators import evaluation as E, state as S
from spindle.operators.records import first_version, latest_version
from spindle.operators.references import normal_key
from spindle.plans.block_queries import SQUEEZE, W
from spindle.plans.graph_queries import chunks
from spindle.session import table
from spindle.streaming.events import streamed_metrics, streamed_progress, streamed_windows

TERMS = ("蓟马", "跳甲", "网蝽", "thrips")
HINTS = ("叶", "病斑", "防治")


def samples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Samples with the columns asked for, so that no more is read and compared than that."""
    t = table(spark, d, "rejected")
    return first_version(t.select("id", "ingested_at", *columns) if columns else t, "id")


def packs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(spark, d, "evidencepack")
    return first_version(t.select("pack_id", "ingested_at", *columns) if columns else t, "pack_id")


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def eval_evidence(spark, d):
    return E.evidence_chunks(packs(spark, d, "evidence"), chunks(spark, d), "pack_id")


def eval_selection(spark, d):
    s = samples(spark, d, "modality", "quality").select("id", "modality", F.col("quality.judge_score").alias("judge_score"), F.col("quality.evidence_score").alias("evidence_score"))
    return E.select_accepted(s, 100, 0.2)


def eval_judge(spark, d):
    return E.judge_totals(samples(spark, d, "quality"))


def eval_validation(spark, d):
    return E.validation_scores(samples(spark, d, "question", "gold_answer", "task_type", "modality", "evidence"), chunks(spark, d))


def eval_report(spark, d):
    return E.dataset_report(samples(spark, d, "task_type", "modality", "metadata", "evidence", "quality"))


def eval_groups(spark, d):
    return E.group_report(samples(spark, d, "task_type", "quality"), "task_type")


def eval_lengths(spark, d):
    """Number, mean and 95 % rank of the length of answers per modality."""
    s = samples(spark, d, "modality", "gold_answer").select(F.coalesce(F.trim("modality"), F.lit("")).alias("modality"), F.length("gold_answer").alias("n_chars"))
    return E.nearest_rank(s, "modality", "n_chars")


def eval_retrieval(spark, d):
    """Scores of the evidence of each sample against the chunks that its entity's packs cite."""
    gold = packs(spark, d, "core_entity", "evidence").select(squeeze(F.col("core_entity")).alias("entity"), F.explode("evidence.chunk_id").alias("c")).filter(F.col("c").isNotNull())
    gold = gold.groupBy("entity").agg(F.sort_array(F.collect_set("c")).alias("gold"))
    s = samples(spark, d, "metadata", "evidence").select("id", squeeze(F.col("metadata.core_entity")).alias("entity"), F.filter("evidence.chunk_id", lambda c: c.isNotNull()).alias("found"))
    return E.retrieval_scores(s.join(gold, "entity")).select("id", "hit", "recall", "precision", "f1")


def eval_review_sheet(spark, d):
    return E.review_sheet(samples(spark, d, "task_type", "modality", "question", "gold_answer", "evidence", "quality", "metadata"))


def eval_flat_evidence(spark, d):
    return E.flat_evidence(samples(spark, d, "task_type", "quality", "metadata", "evidence").drop("ingested_at"))


def eval_sample_ids(spark, d):
    return E.sample_ids(samples(spark, d, "task_type").select("id", F.coalesce(F.trim("task_type"), F.lit("none")).alias("task")), "id", "task")


def event_totals(spark, d):
    return S.event_metrics(events(spark, d)).select("event_type", "n_events", "n_without_value", "total", "first_ts", "last_ts")


def event_status(spark, d):
    return S.latest_status(events(spark, d))


def event_progress(spark, d):
    return S.progress(events(spark, d), {"view": 10, "click": 40, "cart": 65, "purchase": 90})


def event_windows(spark, d):
    return S.windowed_counts(events(spark, d))


def event_json(spark, d):
    """The first JSON object of each event's properties, with its number of keys."""
    e = events(spark, d).select("event_id", first_json_object(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).alias("j"))
    return e.filter(F.col("j").isNotNull()).select("event_id", F.size(F.json_object_keys("j")).alias("n_keys"))


def event_stream_totals(spark, d):
    return streamed_metrics(spark, f"{d}/events.parquet").select("event_type", "n_events", "n_without_value", "total", "first_ts", "last_ts")


def event_stream_progress(spark, d):
    return streamed_progress(spark, f"{d}/events.parquet", {"view": 10, "click": 40, "cart": 65, "purchase": 90})


def event_stream_windows(spark, d):
    return streamed_windows(spark, f"{d}/events.parquet")


def cache_to_do(spark, d):
    """Images of blocks that no image file stands for yet."""
    b = table(spark, d, "test4_content_list").filter(F.col("type") == "image").select(normal_key(F.col("img_path")).alias("img_path")).filter(F.col("img_path").isNotNull()).distinct()
    i = table(spark, d, "image_files").select(normal_key(F.col("img_path")).alias("img_path"), "is_deleted", "ingested_at").filter(F.col("img_path").isNotNull())
    return S.to_do(b, latest_version(i, "img_path").filter(~F.coalesce("is_deleted", F.lit(False))), ["img_path"])


def document_status(spark, d):
    """Per document: its chunks that stand, how many are multimodal, their tokens, and when the last came in."""
    c = table(spark, d, "chunks").select("chunk_id", "full_doc_id", "tokens", "is_multimodal", "is_deleted", "ingested_at")
    c = latest_version(c, "chunk_id").filter(~F.coalesce("is_deleted", F.lit(False)))
    return c.groupBy("full_doc_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.count_if("is_multimodal").alias("n_multimodal"), F.sum("tokens").alias("n_tokens"), F.max("ingested_at").alias("last_at"))


QUERIES = {f.__name__: f for f in (
    eval_evidence, eval_selection, eval_judge, eval_validation, eval_report, eval_groups, eval_lengths, eval_retrieval, eval_review_sheet, eval_flat_evidence,
    eval_sample_ids, event_totals, event_status, event_progress, event_windows, event_json, event_stream_totals, event_stream_progress, event_stream_windows, cache_to_do, document_status,
)}

_S = """with s as (select distinct id, task_type, modality, question, gold_answer, evidence, metadata, quality from rejected),
p as (select distinct pack_id, core_entity, entity_type, evidence, context, modality from evidencepack),
c as (select * from (select chunk_id, arg_max(content, ingested_at) content, arg_max(page_idx, ingested_at) page_idx, arg_max(full_doc_id, ingested_at) full_doc_id, arg_max(tokens, ingested_at) tokens, arg_max(is_multimodal, ingested_at) is_multimodal,
  arg_max(coalesce(is_deleted, false), ingested_at) gone, max(ingested_at) last_at from chunks group by 1) where not gone)
"""
_NORMAL = lambda c: rf"regexp_replace(replace(lower(regexp_replace({c}, '^{W}+|{W}+$', '', 'g')), chr(92), '/'), '^\./', '')"
_EV = "select {k}, unnest(range(0, len(evidence))) position, unnest(evidence).chunk_id chunk_id from {t}"
_CL = "least(greatest(coalesce(quality.judge.{0}, 3), 1), 5)"
_TOTALS = "select event_type, count(*) n_events, count(*) filter (value is null) n_without_value, round(sum(value), 2) total, min(ts) first_ts, max(ts) last_ts from events group by 1"
_WINDOWS = "select date_trunc('day', ts)::timestamp window_start, event_type, count(*) n from events group by 1, 2"
ORACLE_SQL = {
    "eval_evidence": _S + f", e as ({_EV.format(k='pack_id', t='p')}) select pack_id, position, e.chunk_id, page_idx, length(content) n_chars from e join c using (chunk_id) where trim(content) <> ''",
    "eval_selection": _S + """, o as (select id, coalesce(modality = 'image', false) image, row_number() over (order by coalesce(quality.judge_score, 0) desc, coalesce(quality.evidence_score, 0) desc, id) r from s),
      i as (select *, image and row_number() over (partition by image order by r) <= 20 lead from o), n as (select count(*) filter (lead) n from i),
      f as (select *, row_number() over (partition by lead order by r) q from i) select id, lead or q <= 100 - (select n from n) accepted from f""",
    "eval_judge": _S + "select id, a answer_correctness, e evidence_consistency, f safety, l clarity, a + e + f + l total, e >= 3 passed from (select id, " + ", ".join(f"{_CL.format(n)} {x}" for n, x in (("answer_correctness", "a"), ("evidence_consistency", "e"), ("safety", "f"), ("clarity", "l"))) + " from s)",
    "eval_validation": _S + f""", e as ({_EV.format(k='id', t='s')}), b as (select id, count(*) bad from e where chunk_id is null or chunk_id not in (select chunk_id from c) group by 1)
      select s.id, greatest(0.0, round(1 - 0.2 * ((trim(coalesce(question, '')) = '')::int + (trim(coalesce(gold_answer, '')) = '')::int + (trim(coalesce(task_type, '')) = '')::int + (trim(coalesce(modality, '')) = '')::int), 4))::double rule_score,
      case when coalesce(len(evidence), 0) = 0 then 0.0 else greatest(0.0, round(1 - 0.3 * coalesce(bad, 0), 4)) end::double evidence_score from s left join b using (id)""",
    "eval_report": _S + """, x as (select 'task_type' part, trim(task_type) as name from s union all select 'modality', trim(modality) from s union all select 'core_entity', trim(metadata.core_entity) from s
      union all select 'file', f from (select distinct id, unnest(evidence).file_path f from s) union all select 'reason', unnest(string_split(quality.reason, '|')) from s)
      select part, name, count(*) n from x where name is not null and trim(name) <> '' group by 1, 2""",
    "eval_groups": _S + "select coalesce(trim(task_type), '') task_type, count(*) n, count(*) filter (quality.status = 'accepted') n_accepted, round(avg(quality.judge_score), 4) mean_judge, round(avg(quality.evidence_score), 4) mean_evidence, max(quality.rule_score) best_rule from s group by 1",
    "eval_lengths": _S + ", l as (select coalesce(trim(modality), '') modality, length(gold_answer) n from s where gold_answer is not null), r as (select *, row_number() over (partition by modality order by n) r, count(*) over (partition by modality) c from l) select modality, max(c) n, round(avg(n), 4) mean, min(n) filter (r >= greatest(1, floor(c * 0.95))) at_rank from r group by 1",
    "eval_retrieval": _S + f""", g as (select {SQUEEZE('core_entity')} e, list_sort(list_distinct(list(k))) gold from (select core_entity, unnest(evidence).chunk_id k from p) where k is not null group by 1),
      x as (select id, list_distinct(gold) g, list_distinct(list_filter(list_transform(evidence, lambda z: z.chunk_id), lambda k: k is not null)) f from s join g on g.e = {SQUEEZE('s.metadata.core_entity')}),
      y as (select id, len(list_intersect(g, f)) b, len(g) ng, len(f) nf from x)
      select id, (b > 0)::int hit, case when ng > 0 then round(b / ng, 4) else 0 end recall, case when nf > 0 then round(b / nf, 4) else 0 end "precision", case when b > 0 then round(2 * (b / ng) * (b / nf) / (b / ng + b / nf), 4) else 0 end f1 from y""",
    "eval_review_sheet": _S + "select id, coalesce(quality.status, '') status, coalesce(task_type, '') task_type, coalesce(modality, '') modality, '' difficulty, coalesce(metadata.core_entity, '') core_entity, '' entity_type, coalesce(question, '') question, coalesce(gold_answer, '') gold_answer, array_to_string(list_transform(coalesce(evidence, []), lambda z: coalesce(z.chunk_id, '')), '|') evidence_chunks, coalesce(quality.judge_score::varchar, '') judge_score, coalesce(array_to_string(quality.reasons, '|'), '') reasons, '' manual_decision, '' manual_notes from s",
    "eval_flat_evidence": _S + """select id, task_type, quality.status quality_status, quality.reason quality_reason, case when quality.reasons is not null then array_to_string(quality.reasons, '|') end quality_reasons, quality.rule_score quality_rule_score, quality.evidence_score quality_evidence_score, quality.judge_score quality_judge_score,
      quality.judge.answer_correctness quality_judge_answer_correctness, quality.judge.evidence_consistency quality_judge_evidence_consistency, quality.judge.safety quality_judge_safety, quality.judge.clarity quality_judge_clarity, quality.judge.reason quality_judge_reason,
      metadata.core_entity metadata_core_entity, metadata.image_match.match metadata_image_match_match, metadata.image_match.confidence metadata_image_match_confidence, case when metadata.image_match.visible_clues is not null then array_to_string(metadata.image_match.visible_clues, '|') end metadata_image_match_visible_clues, metadata.image_match.reason metadata_image_match_reason,
      e.source_type evidence_source_type, e.chunk_id evidence_chunk_id, e.file_path evidence_file_path, e.quote evidence_quote, case when e.focus_entities is not null then array_to_string(e.focus_entities, '|') end evidence_focus_entities
      from (select *, unnest(case when coalesce(len(evidence), 0) = 0 then [null] else evidence end) e from s)""",
    "eval_sample_ids": _S + "select id, coalesce(trim(task_type), 'none') || '_' || lpad(cast(row_number() over (partition by coalesce(trim(task_type), 'none') order by md5(id), id) as varchar), 8, '0') sample_id from s",
    "event_totals": _TOTALS,
    "event_stream_totals": _TOTALS,
    "event_status": "select user_id, arg_max(event_type, (ts, event_id)) status, arg_max(event_id, (ts, event_id)) event_id from events group by 1",
    "event_progress": "select user_id, max(case event_type when 'view' then 10 when 'click' then 40 when 'cart' then 65 when 'purchase' then 90 else 0 end) progress from events group by 1",
    "event_stream_progress": "select user_id, max(case event_type when 'view' then 10 when 'click' then 40 when 'cart' then 65 when 'purchase' then 90 else 0 end) progress from events group by 1",
    "event_windows": _WINDOWS,
    "event_stream_windows": _WINDOWS,
    "event_json": "select event_id, len(json_keys(props)) n_keys from events where props is not null and json_valid(props)",
    "cache_to_do": f"with i as (select {_NORMAL('img_path')} k, arg_max(coalesce(is_deleted, false), ingested_at) gone from image_files where img_path is not null group by 1) select distinct {_NORMAL('img_path')} img_path from test4_content_list where type = 'image' and {_NORMAL('img_path')} <> '' and {_NORMAL('img_path')} not in (select k from i where not gone)",
    "document_status": _S + "select full_doc_id, count(*) n_chunks, count(*) filter (is_multimodal) n_multimodal, sum(tokens)::bigint n_tokens, max(last_at) last_at from c group by 1",
}
