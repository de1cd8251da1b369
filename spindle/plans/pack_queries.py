"""Queries over evidence packs, the building and the running of evaluation data, and the SQL they are checked against.

Where a model would be asked, stand-ins that follow from the row are used, so that SQL can follow them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from spindle.functions.ontology import DEFAULT as O
from spindle.functions.predicates import label_terms
from spindle.functions.text import squeeze
from spindle.operators import evaluation as E, packs as P, runs as R
from spindle.operators.graph import keys_of
from spindle.operators.records import first_version
from spindle.plans.block_queries import SQUEEZE
from spindle.plans.evaluation_queries import HINTS, TERMS
from spindle.plans.graph_queries import _Q, chunks, edges, nodes
from spindle.session import table, written

#: Quotas of the kinds of samples, and the beginnings of their ids.
QUOTAS = {"病虫害诊断": 45, "防治建议": 45, "药剂推荐": 35, "症状识别": 35, "图像问答": 30, "证据不足": 10}
PREFIXES = {"病虫害诊断": "diag", "防治建议": "control", "药剂推荐": "pesticide", "症状识别": "symptom", "图像问答": "image", "证据不足": "unknown"}


#: Kinds that names of these tables end in; texts speak of the kind more often than of the very name.
KINDS = "(蓟马|跳甲|网蝽|蚜虫|象甲|种蝇|瘿螨|螟虫|夜蛾|腐病|枯病|锈病|斑病|霉病|白菜|芥蓝)"


def by_kind(c: str) -> Column:
    kind = F.regexp_extract(c, KINDS, 1)
    return F.when(kind != "", kind).otherwise(F.col(c))


def kinds(spark: SparkSession, d: str) -> DataFrame:
    """Edges between kinds."""
    return edges(spark, d).withColumn("source", by_kind("source")).withColumn("target", by_kind("target"))


def standing(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by knowledge base and kind, or name where it tells none: the later of several stands."""
    n = nodes(spark, d).withColumn("id", by_kind("id"))
    return n.groupBy("kb_id", "id").agg(F.max("node_id").alias("node_id"), F.max_by(F.struct("entity_type", "source_ids"), "node_id").alias("n")).select("kb_id", "id", "node_id", "n.*")


def packs(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    return first_version(table(spark, d, "evidencepack").select("pack_id", "ingested_at", *columns), "pack_id")


def samples(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    t = table(spark, d, "rejected")
    return first_version(t.select("id", "ingested_at", *columns) if columns else t, "id")


def _shown(p: DataFrame) -> DataFrame:
    return p.select("kb_id", "pack_id", "core_entity", "entity_type", F.array_join("expected_entities", "|").alias("entities"), F.array_join("expected_relations", "|").alias("relations"), "n_evidence",
                    F.array_join("evidence.chunk_id", "|").alias("cited"), F.md5(F.array_join("evidence.quote", "|")).alias("quotes"), F.md5("context").alias("context"))


def pack_entities(spark, d):
    return _shown(P.entity_packs(standing(spark, d), kinds(spark, d), chunks(spark, d)))


def pack_relations(spark, d):
    return _shown(P.relation_packs(standing(spark, d), kinds(spark, d), chunks(spark, d)))


def pack_images(spark, d):
    m = packs(spark, d, "image_path", "core_entity", "expected_entities", "modality").filter("modality = 'image'").select(F.col("pack_id").alias("image_id"), "image_path", by_kind("core_entity").alias("target"), F.coalesce("expected_entities", F.array().cast("array<string>")).alias("labels"))
    return _shown(P.image_packs(m, standing(spark, d), chunks(spark, d)))


def pack_labels(spark, d):
    """All labels of image packs."""
    p = packs(spark, d, "core_entity", "expected_entities", "modality").filter("modality = 'image'")
    return p.select("pack_id", F.array_join(label_terms([F.col("core_entity")], [F.col("expected_entities")]), "|").alias("labels"))


def eval_quotes(spark, d):
    c = chunks(spark, d).select("chunk_id", "content").withColumn("terms", F.array(*map(F.lit, TERMS)))
    q = P.with_quote(c, "content", "terms", "quote", 60)
    return q.filter(F.col("quote") != "").select("chunk_id", "quote")


def _tasks(spark, d):
    return P.task_packs(packs(spark, d, "entity_type", "context", "modality", "evidence"))


def eval_task_packs(spark, d):
    return _tasks(spark, d)


def eval_quotas(spark, d):
    """Quotas for 100 samples: scaled, then with at least 30 % images."""
    q = P.image_quotas(E.scaled_quotas(QUOTAS, 100), 100, "图像问答", 0.3)
    return spark.createDataFrame(list(q.items()), "task string, quota long")


def _sampled(spark, d):
    q = R.oversampled({k: 40 for k in QUOTAS})
    return P.numbered(P.sampled_packs(_tasks(spark, d), q), PREFIXES)


def eval_sampled_packs(spark, d):
    return _sampled(spark, d).select("task", "pack_id", "number", "sample_id")


def generated(pack: dict) -> dict:
    """A stand-in for a model that writes samples: fails for one core entity in seven, forgets the answer for one in eleven."""
    name = pack.get("core_entity") or ""
    if len(name) % 7 == 0:
        raise RuntimeError("no answer from the model")
    return {"question": f"{name}?", "gold_answer": "" if len(name) % 11 == 0 else f"{name}!"}


def judged(sample: dict) -> dict:
    """A stand-in for a judge: marks follow from the length of the question; none for one in five."""
    n = len(sample.get("question") or "")
    return {"answer_correctness": 9, "evidence_consistency": n % 6, "clarity": "x"} if n % 5 else {}


def verified(row: dict) -> dict:
    n = len(row.get("core_entity") or row.get("question") or "")
    return {"match": n % 3 > 0, "confidence": 0.5, "visible_clues": ["a"], "reason": "r"}


def eval_built(spark, d):
    """Samples built from the sampled packs by stand-ins: how each came out."""
    p = packs(spark, d, "core_entity", "entity_type", "context", "modality", "expected_entities", "expected_relations", "evidence", "image_path")
    fed = _sampled(spark, d).select("sample_id", "task", "pack_id").join(p.withColumn("core_entity", squeeze(F.col("core_entity"))), "pack_id")
    s = R.built_samples(fed, generated, judged, chunks(spark, d).select("chunk_id"), verified)
    return s.select("id", "question", "gold_answer", F.col("quality.status").alias("status"), F.col("quality.reason").alias("reason"), F.col("quality.rule_score").alias("rule_score"), F.col("quality.evidence_score").alias("evidence_score"), F.col("quality.judge_score").alias("judge_score"))


def eval_minimized(spark, d):
    m = R.minimized(samples(spark, d), judged=False)
    return m.select("id", "task_type", "gold_answer", F.size("evidence").cast("long").alias("n"), F.array_join("evidence.chunk_id", "|").alias("cited"), F.col("metadata.core_entity").alias("entity"), F.col("quality.status").alias("status"), F.col("quality.judge_score").alias("judge_score"), F.array_join("quality.reasons", "|").alias("reasons"))


def eval_promotable(spark, d):
    s = samples(spark, d, "modality", "question", "gold_answer", "image_path", "quality")
    return s.select("id", R.promotable().alias("promotable"), R.promotable(True).alias("with_over_target"), R.rejudge_target().alias("rejudge"))


def _halves(spark, d):
    s = samples(spark, d)
    good = F.coalesce(F.col("quality.judge_score"), F.lit(0)) >= 12
    return s.filter(good), s.filter(~good)


def eval_promoted(spark, d):
    """Accepted and rejected samples after promotion, as many text samples giving way as are promoted."""
    a, r = _halves(spark, d)
    a, r = R.promote(a, r, keep_size=True, over_target=True)
    show = lambda x, side: x.select("id", F.lit(side).alias("side"), F.col("quality.status").alias("status"), F.col("quality.reason").alias("reason"))
    return show(a, "accepted").unionByName(show(r, "rejected"))


def eval_marked(spark, d):
    s = R.marked_rejected(samples(spark, d, "quality"), F.array(F.lit("checked"), F.lit("twice")))
    return s.select("id", F.array_join("quality.reasons", "|").alias("reasons"), F.col("quality.reason").alias("reason"), F.col("quality.status").alias("status"))


def eval_rejudged(spark, d):
    m = packs(spark, d, "image_path", "notes", "expected_entities").filter(F.col("image_path").isNotNull()).select("image_path", "notes", F.col("expected_entities").alias("labels"))
    s = R.rejudged(samples(spark, d), m, verified, judged)
    return s.select("id", "outcome", F.col("quality.status").alias("status"), F.col("quality.reason").alias("reason"), F.col("quality.judge_score").alias("judge_score"))


def eval_manifest_join(spark, d):
    """Rejected samples with the notes of their image."""
    m = packs(spark, d, "image_path", "notes", "expected_entities").filter(F.col("image_path").isNotNull()).select("image_path", "notes", F.col("expected_entities").alias("labels"))
    return R.with_manifest(samples(spark, d, "image_path"), m).select("id", "notes")


def described(row: dict) -> dict:
    """A stand-in for a model that looks at images; one name in nine fails."""
    if len(row["target"]) % 9 == 0:
        raise RuntimeError("no answer from the model")
    return {"crop": "cabbage", "symptoms": ["spots"], "visible_clues": ["a", "b"], "confidence": 1.5}


def eval_manifest(spark, d):
    """Labels of images by their file names, those of bulletins being a placeholder."""
    i = table(spark, d, "image_files").select(F.translate("file_path", " ", "").alias("image_path")).filter(F.col("image_path").isNotNull()).distinct()
    m = R.manifest_rows(i, described, "bulletin", ("cabbage", "kale"), "other")
    return m.select("image_path", "crop", "target", F.array_join("symptoms", "|").alias("symptoms"), "notes", "number", "inferred", "confidence", "error")


def answered(sample: dict) -> dict:
    """A stand-in for the engine: fails for one id in eight, else cites what the sample itself cites first."""
    if sum(map(ord, sample["id"])) % 8 == 0:
        raise RuntimeError("timeout " * 80)
    return {"answer": sample.get("question") or "", "chunk_ids": ["none"]}


def marked(sample: dict, said: str) -> dict:
    n = len(said)
    return {"correctness": n, "evidence_consistency": n % 7, "safety": "4", "completeness": None}


def _run(spark, d):
    s = samples(spark, d, "task_type", "modality", "question", "gold_answer", "image_path", "evidence")
    return written(R.evaluated(s, answered, marked, clock=lambda: 0.0), "run")


def eval_run(spark, d):
    return _run(spark, d).select("id", F.length("system_answer").alias("n_chars"), "total_score", "pass", F.size("gold").cast("long").alias("n_gold"), "hit", "f1", F.length("error").alias("error"))


def eval_run_report(spark, d):
    return R.run_report(_run(spark, d), "task_type")


def eval_run_summary(spark, d):
    return R.run_summary(_run(spark, d)).select("samples", "success", "error_count", "pass_rate", "avg_total_score", "p95_latency_sec")


def eval_build_report(spark, d):
    a, r = _halves(spark, d)
    return R.build_report(a, r, F.col("accepted") + F.col("rejected"))


def eval_five_marks(spark, d):
    j = F.col("quality.judge")
    five = F.struct(j["answer_correctness"].alias("correctness"), j["evidence_consistency"].alias("evidence_consistency"), j["safety"].alias("safety"), F.lit(None).cast("int").alias("completeness"), j["clarity"].alias("clarity"))
    return samples(spark, d, "quality").withColumn("five", five).select("id", R.five_marks(F.col("five")).alias("m")).select("id", "m.total", F.col("m")["pass"].alias("pass"))


def pack_names(spark, d):
    """Names that are known: those of nodes by kind, and those that chunks of packs are about."""
    n = standing(spark, d).select(F.col("id").alias("name"))
    return n.unionByName(packs(spark, d, "expected_entities").select(F.explode("expected_entities").alias("name"))).filter(F.col("name").isNotNull()).distinct()


QUERIES = {f.__name__: f for f in (
    pack_entities, pack_relations, pack_images, pack_labels, eval_quotes, eval_task_packs, eval_quotas, eval_sampled_packs, eval_built, eval_minimized, eval_promotable, eval_promoted, eval_marked, eval_rejudged,
    eval_manifest_join, eval_manifest, eval_run, eval_run_report, eval_run_summary, eval_build_report, eval_five_marks, pack_names,
)}

_HINTS = lambda x: " + ".join(f"contains({x}, '{h}')::int" for h in O.hint_terms)
_CLEAN = lambda c: rf"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace({SQUEEZE(c)}, '(?:图片路径|Image Path)\s*[:：]\s*\S+\s*', '', 'gi'), '图片内容分析\s*[:：]\s*', '', 'g'), '标注\s*[:：]\s*None\s*', '', 'g'), '脚注\s*[:：]\s*None\s*', '', 'g'))"


def _quotes(source: str, key: str, mosts: dict[str, int]) -> str:
    """CTEs q0 to q4 from rows of source (key, content, terms): the best sentence and its neighbours, cut to each of mosts."""
    cut = lambda m: f"case when quote is null then '' when length(quote) <= {m} then quote when fst is null then rtrim(quote[1:{m}]) else (case when least(greatest(fst - 1 - {m // 3}, 0), length(quote) - {m}) > 0 then '...' else '' end) || trim(substr(quote, least(greatest(fst - 1 - {m // 3}, 0), length(quote) - {m}) + 1, {m})) || (case when least(greatest(fst - 1 - {m // 3}, 0), length(quote) - {m}) + {m} < length(quote) then '...' else '' end) end"
    return rf"""
q0 as (select *, {_CLEAN('content')} cl, list_filter(list_transform(terms, lambda t: trim(t)), lambda t: length(t) >= 2 and t not in ({_Q(O.generic_terms)})) fo from {source}),
q1 as (select *, list_filter(list_transform(string_split(regexp_replace(cl, '([。！？；;])\s*', '\1' || chr(1), 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') s0 from q0),
q2 as (select *, case when len(s0) > 0 then s0 else [trim(cl)] end s from q1),
q3 as (select *, list_transform(s, lambda x: len(list_filter(fo, lambda t: contains(x, t)))) h from q2),
q4 as (select *, list_transform(range(1, len(s) + 1), lambda i: case when h[i] > 0 then 3 * h[i] + {_HINTS('s[i]')} end) sc from q3),
q5 as (select *, case when list_max(sc) is not null then list_position(sc, list_max(sc)) end i from q4),
q6 as (select *, trim((case when i > 1 and h[i - 1] > 0 then s[i - 1] else '' end) || s[i] || (case when i < len(s) and h[i + 1] > 0 then s[i + 1] else '' end)) quote from q5),
q7 as (select *, list_min(list_filter(list_transform(fo, lambda t: strpos(quote, t)), lambda p: p > 0)) fst from q6),
q8 as (select {key}, {', '.join(f'{cut(m)} {n}' for n, m in mosts.items())} from q7)"""


_KIND = lambda c: f"coalesce(nullif(regexp_extract({c}, '{KINDS}', 1), ''), {c})"
_BASE = f"""with n0 as (select node_id, any_value(kb_id) kb_id, {_KIND('any_value(id)')} id, any_value(entity_type) entity_type, any_value(source_ids) source_ids from graphnode where id is not null group by 1),
n as (select kb_id, id, max(node_id) node_id, arg_max(entity_type, node_id) entity_type, arg_max(source_ids, node_id) source_ids from n0 group by 1, 2),
e as (select edge_id, any_value(kb_id) kb_id, {_KIND('any_value(source)')} source, {_KIND('any_value(target)')} target, any_value(relation_type) relation_type, any_value(source_ids) source_ids from graphedge group by 1),
c as (select chunk_id, content, file_path from (select chunk_id, arg_max(content, ingested_at) content, arg_max(file_path, ingested_at) file_path, arg_max(coalesce(is_deleted, false), ingested_at) gone from chunks group by 1) where not gone and trim(content) <> ''),
p as (select pack_id, any_value(core_entity) core_entity, any_value(entity_type) entity_type, any_value(evidence) evidence, any_value(context) context, any_value(modality) modality, any_value(image_path) image_path, any_value(notes) notes, any_value(expected_entities) expected_entities from evidencepack group by 1),
s as (select id, any_value(task_type) task_type, any_value(modality) modality, any_value(question) question, any_value(gold_answer) gold_answer, any_value(image_path) image_path, any_value(evidence) evidence, any_value(metadata) metadata, any_value(quality) quality from rejected group by 1)"""
_KEYS = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
_FLAT = "list_filter(flatten(list_transform(coalesce(source_ids, []), lambda s: list_transform(string_split(coalesce(s, ''), '<SEP>'), lambda x: trim(x)))), lambda x: x <> '')"


def _packed(owners: str, select: str) -> str:
    """SQL of packs from owners (pack_id, ks, terms and what select names)."""
    return _BASE + f""", ow as ({owners}),
rw as (select pack_id, terms, unnest(range(0, len(ks))) pos, unnest(ks) chunk_id from ow), src as (select rw.*, content, file_path from rw join c using (chunk_id)),""" + _quotes("src", "pack_id, pos, chunk_id, file_path", {"quote": P.QUOTE, "passage": P.PASSAGE}) + f""",
r0 as (select *, case when passage <> '' then passage else quote end piece, row_number() over (partition by pack_id order by pos) r from q8 where quote <> ''),
r1 as (select *, coalesce(sum(length(piece)) over (partition by pack_id order by pos rows between unbounded preceding and 1 preceding), 0) used from r0),
ev as (select pack_id, count(*) n_evidence, string_agg(chunk_id, '|' order by r) filter (r <= 3) cited, md5(string_agg(quote, '|' order by r) filter (r <= 3)) quotes, md5(string_agg('[' || chunk_id || '] ' || piece[1:({P.CONTEXT} - used)::bigint], chr(10) order by r) filter (used < {P.CONTEXT})) context from r1 group by 1)
{select}"""


_ENDS = """, en as (select kb_id, source id, target other, relation_type, edge_id, 0 z from e where source is not null and target is not null union all select kb_id, target, source, relation_type, edge_id, 1 from e where source <> target),
o4 as (select kb_id, id, list(other order by a, other) l from (select *, row_number() over (partition by kb_id, id order by a, other) r from (select kb_id, id, other, min((edge_id, z)) a from en where other <> '' group by 1, 2, 3)) where r <= 4 group by 1, 2),
t5 as (select kb_id, id, list(relation_type order by a, relation_type) l from (select *, row_number() over (partition by kb_id, id order by a, relation_type) r from (select kb_id, id, relation_type, min((edge_id, z)) a from en where relation_type <> '' group by 1, 2, 3)) where r <= 5 group by 1, 2)"""
_DISTINCT = lambda l: f"array_to_string(list_filter({l}, lambda x, i: list_position({l}, x) = i), '|')"
_FITS = {
    t.name: f"modality = '{t.modality}'" + (f" and (entity_type in ({_Q(t.types)}) or regexp_matches(said, '{'|'.join(t.terms)}'))" if t.either else (f" and entity_type in ({_Q(t.types)})" if t.types else "") + (f" and regexp_matches(said, '{'|'.join(t.terms)}')" if t.terms else ""))
    for t in O.tasks
}
_TASKS = _BASE + ", sd as (select *, coalesce(context, '') || ' ' || coalesce(array_to_string(list_transform(evidence, lambda z: coalesce(z.quote, '')), ' '), '') said from p), tk as (" + " union all ".join(f"select pack_id, '{k}' task from sd where {v}" for k, v in _FITS.items()) + ")"
_PICKED = _TASKS + """, sz as (select task, count(*) size from tk group by 1), pl as (select task, size, 60 needed, ceil(60 / size)::bigint rounds from sz),
ea as (select tk.task, pack_id, size, needed, unnest(range(0, rounds)) rd from tk join pl using (task)),
rk as (select *, row_number() over (partition by task, rd order by md5(task || '|' || pack_id || '|' || rd || '|42'), pack_id) r from ea),
pk as (select task, pack_id, (rd * size + r)::bigint number from rk where r <= needed - rd * size),
nu as (select *, case task """ + " ".join(f"when '{k}' then '{v}'" for k, v in PREFIXES.items()) + """ else 'qa' end || '_' || case when number < 1000 then lpad(number::varchar, 4, '0') else number::varchar end sample_id from pk)"""
_BAD = "len(list_filter(p.evidence, lambda z: z.chunk_id is null or z.chunk_id not in (select chunk_id from cc)))"
_GOOD = "coalesce(quality.judge_score, 0) >= 12"
_FILL = lambda c: f"trim(coalesce({c}, '')) <> ''"
_PROMOTE = lambda more: f"coalesce(modality = 'image' and quality.reason in ('judge_rejected', 'judge_rejected_after_image_rejudge'{more}), false) and {_FILL('question')} and {_FILL('gold_answer')}"
_REJUDGE = f"coalesce(modality = 'image', false) and {_FILL('question')} and {_FILL('gold_answer')} and {_FILL('image_path')}"
_REASONS = "array_to_string(list_concat(coalesce(quality.reasons, []), {0}), '|')"
_MAN = ", mn as (select trim(image_path) ip, max(coalesce(notes, '')) notes from p where image_path is not null group by 1)"
_ORD = "list_sum(list_transform(string_split(id, ''), lambda x: ord(x)))"
_RUN = _BASE + f""", ru as (select id, coalesce(task_type, '') task_type, {_ORD} % 8 = 0 bad, coalesce(trim(question), '') said, list_filter(list_transform(evidence, lambda z: z.chunk_id), lambda k: k <> '') gold from s),
rv as (select *, case when bad then null else least(greatest(length(said), 1), 5) end m1, case when bad then null else least(greatest(length(said) % 7, 1), 5) end m2 from ru),
rs as (select *, m1 + m2 + 4 + 3 + 3 total_score, case when bad then false else m1 >= 4 and m2 >= 4 end pass from rv)"""
ORACLE_SQL = {
    "pack_entities": _packed(f"select 'entity::' || kb_id || '::' || id pack_id, {_KEYS.format(_FLAT)} ks, [id] terms from n where entity_type in ({_Q(O.pack_types)})", f", nn as (select *, 'entity::' || kb_id || '::' || id pack_id from n where entity_type in ({_Q(O.pack_types)})) {_ENDS} select nn.kb_id, nn.pack_id, nn.id core_entity, entity_type, {_DISTINCT('list_concat([nn.id], coalesce(o4.l, []))')} entities, coalesce(array_to_string(t5.l, '|'), '') relations, n_evidence, cited, quotes, coalesce(context, md5('')) context from nn join ev using (pack_id) left join o4 on o4.kb_id = nn.kb_id and o4.id = nn.id left join t5 on t5.kb_id = nn.kb_id and t5.id = nn.id"),
    "pack_relations": _packed(f"select concat_ws('::', 'relation', edge_id, source, target) pack_id, {_KEYS.format(_FLAT)} ks, list_filter([source, target, relation_type], lambda t: t is not null) terms from e", f", ee as (select *, concat_ws('::', 'relation', edge_id, source, target) pack_id from e) select ee.kb_id, pack_id, source core_entity, coalesce(nullif(a.entity_type, ''), b.entity_type, '') entity_type, {_DISTINCT('list_filter([source, target], lambda x: x is not null)')} entities, case when coalesce(relation_type, '') <> '' then relation_type else '{O.related}' end relations, n_evidence, cited, quotes, coalesce(context, md5('')) context from ee join ev using (pack_id) left join n a on a.kb_id = ee.kb_id and a.id = ee.source left join n b on b.kb_id = ee.kb_id and b.id = ee.target"),
    "pack_images": _packed(f"""select 'image::' || m.pack_id pack_id, list(distinct k) ks0, list(k order by a, k) ks, any_value(terms) terms, any_value(core) core from
      (select m.pack_id, k, min((m.place, n.i)) a, any_value(mt.l) terms, any_value(case when tg <> '' then tg else mt.l[1] end) core from mm m join (select id, unnest(range(1, len(kk) + 1)) i, unnest(kk) k from (select id, {_KEYS.format(_FLAT)} kk from n)) n on n.id = m.t join mt on mt.pack_id = m.pack_id where (tg = '' or list_contains(mt.l, tg)) group by 1, 2) m group by 1""", f"select null::varchar kb_id, pack_id, core core_entity, coalesce(nullif(kd.entity_type, ''), '{O.pictured}') entity_type, array_to_string(terms, '|') entities, '' relations, n_evidence, cited, quotes, coalesce(context, md5('')) context from ow join ev using (pack_id) left join (select id, arg_max(entity_type, node_id) entity_type from n group by 1) kd on kd.id = core").replace(", ow as (", """, ip as (select pack_id, trim(coalesce(""" + _KIND('core_entity') + """, '')) tg, list_filter(list_concat([trim(coalesce(""" + _KIND('core_entity') + """, ''))], list_transform(coalesce(expected_entities, []), lambda x: trim(x))), lambda x: x <> '') ls from p where modality = 'image'),
      mm as (select pack_id, tg, place, t from (select pack_id, tg, unnest(range(0, len(l2))) place, unnest(l2) t from (select pack_id, tg, list_filter(ls, lambda x, i: list_position(ls, x) = i) l2 from ip)) where t in (select id from n)), mt as (select pack_id, list(t order by place) l from mm group by 1), ow as (""", 1),
    "pack_labels": _BASE + " select pack_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') labels from (select pack_id, list_filter(list_transform(list_concat([core_entity], coalesce(expected_entities, [])), lambda x: trim(x)), lambda x: x <> '') l from p where modality = 'image')",
    "eval_quotes": _BASE + f", sr as (select chunk_id, content, [{_Q(TERMS)}] terms from c)," + _quotes("sr", "chunk_id", {"quote": 60}) + " select chunk_id, quote from q8 where quote <> ''",
    "eval_task_packs": _TASKS + " select pack_id, task from tk",
    "eval_quotas": "select * from (values ('病虫害诊断', 19), ('防治建议', 19), ('药剂推荐', 15), ('症状识别', 15), ('图像问答', 30), ('证据不足', 2)) t(task, quota)",
    "eval_sampled_packs": _PICKED + " select task, pack_id, number, sample_id from nu",
    "eval_built": _PICKED + f""", cc as (select chunk_id from (select chunk_id, arg_max(coalesce(is_deleted, false), ingested_at) gone from chunks group by 1) where not gone),
      bd as (select pack_id, count(*) filter (k is null or k not in (select chunk_id from cc)) bad, count(*) n from (select pack_id, unnest(evidence).chunk_id k from p) group by 1),
      b0 as (select sample_id, task, p.modality, {SQUEEZE('core_entity')} ce, length({SQUEEZE('core_entity')}) l, coalesce(bad, 0) bad, coalesce(n, 0) n from nu join p using (pack_id) left join bd using (pack_id)),
      b1 as (select *, modality = 'image' and l % 3 = 0 mism, l % 7 = 0 err, case when l % 11 = 0 then '' else ce || '!' end ans from b0),
      b2 as (select *, case when ans = '' then 0.8 else 1.0 end rule, case when n > 0 then greatest(0.0, round(1 - 0.3 * bad, 4)) else 0.0 end evs, (l + 1) % 5 = 0 nomark, case when (l + 1) % 5 = 0 then 3 else least(greatest((l + 1) % 6, 1), 5) end ec from b1),
      b3 as (select *, case when mism then 'image_target_mismatch' when err then 'generation_error' when ans = '' or bad > 0 or n = 0 then array_to_string(list_filter([case when ans = '' then 'missing_gold_answer' end, case when bad > 0 then 'invalid_chunk' end, case when n = 0 then 'no_evidence' end], lambda x: x is not null), '|') when ec < 3 then 'judge_rejected' else '' end reason from b2)
      select sample_id id, case when coalesce(mism, false) or err then '' else ce || '?' end question, case when coalesce(mism, false) or err then '' else ans end gold_answer, case when reason = '' then 'candidate' else 'rejected' end status, reason, case when coalesce(mism, false) or err then 0.0 else rule end::double rule_score,
      case when coalesce(mism, false) or err then 0.0 else evs end::double evidence_score, case when reason in ('', 'judge_rejected') then case when nomark then 3 else 5 end + ec + 3 + 3 else 0 end judge_score from b3""",
    "eval_minimized": _BASE + " select id, coalesce(task_type, '') task_type, coalesce(gold_answer, '') gold_answer, coalesce(len(evidence), 0) n, array_to_string(list_transform(coalesce(evidence, []), lambda z: coalesce(z.chunk_id, '')), '|') cited, coalesce(metadata.core_entity, '') entity, coalesce(quality.status, 'candidate') status, coalesce(quality.judge_score, 0) judge_score, case when len(quality.reasons) > 0 then array_to_string(quality.reasons, '|') end reasons from s",
    "eval_promotable": _BASE + f" select id, {_PROMOTE('')} promotable, {_PROMOTE(', ' + chr(39) + 'over_target_size' + chr(39))} with_over_target, {_REJUDGE} rejudge from s",
    "eval_promoted": _BASE + f""", up as (select id from s where not ({_GOOD}) and {_PROMOTE(', ' + chr(39) + 'over_target_size' + chr(39))}), dn as (select id from (select id, row_number() over (order by coalesce(quality.judge_score, 0), id desc) r from s where {_GOOD} and not coalesce(modality = 'image', false)) where r <= (select count(*) from up))
      select id, case when id in (select id from up) or ({_GOOD} and id not in (select id from dn)) then 'accepted' else 'rejected' end side, case when id in (select id from up) then 'accepted' when id in (select id from dn) then 'rejected' else quality.status end status,
      case when id in (select id from up) then '' when id in (select id from dn) then {_REASONS.format("['over_target_size']")} else quality.reason end reason from s""",
    "eval_marked": _BASE + f" select id, {_REASONS.format(chr(91) + chr(39) + 'checked' + chr(39) + ', ' + chr(39) + 'twice' + chr(39) + chr(93))} reasons, {_REASONS.format(chr(91) + chr(39) + 'checked' + chr(39) + ', ' + chr(39) + 'twice' + chr(39) + chr(93))} reason, 'rejected' status from s",
    "eval_rejudged": _BASE + f""", j0 as (select *, {_REJUDGE} tg, length(question) l from s), j1 as (select *, l % 3 > 0 mt, l % 5 = 0 nomark, case when l % 5 = 0 then 3 else least(greatest(l % 6, 1), 5) end ec from j0),
      j2 as (select *, case when not tg then 'untouched' when mt and ec >= 3 then 'promoted' else 'still_rejected' end outcome, case when not mt then 'image_target_mismatch_after_image_rejudge' else 'judge_rejected_after_image_rejudge' end nr from j1)
      select id, outcome, case outcome when 'promoted' then 'accepted' when 'still_rejected' then 'rejected' else quality.status end status, case outcome when 'promoted' then '' when 'still_rejected' then {_REASONS.format('[nr]')} else quality.reason end reason,
      case when outcome <> 'untouched' and mt then case when nomark then 3 else 5 end + ec + 3 + 3 else quality.judge_score end judge_score from j2""",
    "eval_manifest_join": _BASE + _MAN + " select id, coalesce(notes, '') notes from s left join mn on mn.ip = trim(image_path)",
    "eval_manifest": r"""with i as (select distinct replace(file_path, ' ', '') image_path from image_files where file_path is not null), p as (select image_path, list_filter(list_transform(string_split(replace(regexp_replace(regexp_extract(image_path, '([^/]*)$', 1), '\.[^.]*$', ''), '-', '_'), '_'), lambda x: trim(x)), lambda x: x <> '') l from i),
      q as (select *, case when len(l) < 3 then 'a name has crop, target and number' when length(l[2]) % 9 = 0 then 'no answer from the model' else '' end error from p)
      select image_path, case when error = '' then case when lower(l[1]) = 'bulletin' then 'cabbage' else l[1] end end crop, case when error = '' then l[2] end target, case when error = '' then 'spots' end symptoms, case when error = '' then 'a；b' end notes, case when error = '' then array_to_string(l[3:], '_') end number, case when error = '' then lower(l[1]) = 'bulletin' end inferred, case when error = '' then 1.0 end::double confidence, error from q""",
    "eval_run": _RUN + " select id, case when bad then 0 else length(said) end n_chars, total_score, pass, coalesce(len(gold), -1) n_gold, 0 hit, 0.0::double f1, case when bad then 500 else 0 end error from rs",
    "eval_run_report": _RUN + " select task_type, count(*) samples, count(*) filter (not bad) success, count(*) filter (bad) error_count, round(count(*) filter (pass) / greatest(count(*) filter (not bad), 1), 4) pass_rate, coalesce(round(avg(total_score), 4), 0) avg_total_score, coalesce(round(avg(m1), 4), 0) avg_correctness, coalesce(round(avg(m2), 4), 0) avg_evidence_consistency, case when count(*) filter (not bad) > 0 then 4.0 else 0 end::double avg_safety, case when count(*) filter (not bad) > 0 then 3.0 else 0 end::double avg_completeness, case when count(*) filter (not bad) > 0 then 3.0 else 0 end::double avg_clarity, 0.0::double avg_recall, 0.0::double avg_precision, 0.0::double avg_f1, 0.0::double avg_latency_sec from rs group by 1",
    "eval_run_summary": _RUN + " select count(*) samples, count(*) filter (not bad) success, count(*) filter (bad) error_count, round(count(*) filter (pass) / greatest(count(*) filter (not bad), 1), 4) pass_rate, coalesce(round(avg(total_score), 4), 0) avg_total_score, 0.0::double p95_latency_sec from rs",
    "eval_build_report": _BASE + f""", a as (select * from s where {_GOOD}), r as (select * from s where not ({_GOOD})), v as (select count(*) n, (select count(*) from r) m, coalesce(round(avg(quality.rule_score), 4), 0) rs, coalesce(round(avg(quality.evidence_score), 4), 0) es, coalesce(round(avg(quality.judge_score), 4), 0) js from a),
      x as (select 'task_type' part, trim(task_type) as name from a union all select 'modality', trim(modality) from a union all select 'core_entity', trim(metadata.core_entity) from a union all select 'evidence_chunk', unnest(evidence).chunk_id from a union all select 'rejection_reason', unnest(quality.reasons) from r),
      y as (select part, name, count(*) n from x where coalesce(name, '') <> '' group by 1, 2), z as (select *, row_number() over (partition by part order by n desc, name) k from y)
      select part, name, n, case when part in ('core_entity', 'evidence_chunk') then k end::int "rank", null::double "value" from z where part not in ('core_entity', 'evidence_chunk') or k <= 20
      union all select 'counts', 'candidates', n + m, null, null from v union all select 'counts', 'accepted', n, null, null from v union all select 'counts', 'rejected', m, null, null from v union all select 'counts', 'acceptance_rate', null, null, round(n / greatest(1, n + m), 4) from v
      union all select 'quality', 'avg_rule_score', null, null, rs from v union all select 'quality', 'avg_evidence_score', null, null, es from v union all select 'quality', 'avg_judge_score', null, null, js from v""",
    "eval_five_marks": _BASE + " select id, a + b + c + 3 + d total, a >= 4 and b >= 4 and c >= 4 pass from (select id, " + ", ".join(f"least(greatest(coalesce(quality.judge.{k}, 3), 1), 5) {x}" for k, x in (("answer_correctness", "a"), ("evidence_consistency", "b"), ("safety", "c"), ("clarity", "d"))) + " from s)",
    "pack_names": _BASE + " select id as name from n union select e from (select unnest(expected_entities) e from p) where e is not null",
}
