"""Queries over the cleanup of whole graphs, and the SQL they are checked against."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.functions.ontology import DEFAULT as O
from spindle.functions.text import squeeze
from spindle.operators import cleanup as C
from spindle.operators.graph import similar_names
from spindle.operators.records import first_version
from spindle.plans.block_queries import SQUEEZE
from spindle.plans.graph_queries import _ALIKE, _ANY, _FIELDS, _LADDER, _LISTED, _MARKS, _N, _PAIRS, _Q, _STAGE
from spindle.session import table, written

#: Names are merged from this similarity on in these queries; few names of the test tables are closer.
ALIKE = 0.8


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return first_version(table(spark, d, "graphnode"), "node_id")


def edges(spark: SparkSession, d: str) -> DataFrame:
    return first_version(table(spark, d, "graphedge"), "edge_id")


def _slots(spark, d):
    return C.slots(nodes(spark, d), edges(spark, d), name="slots")


def _digest(c: str):
    return F.md5(F.array_join(c, "|"))


def cleanup_entities(spark, d):
    n = C.normalized_nodes(nodes(spark, d))
    return n.select("node_id", "name", "entity_type", "modality", F.array_join("aliases", "|").alias("aliases"))


def cleanup_slots(spark, d):
    g = _slots(spark, d).nodes
    return g.select("kb_id", "name", "entity_type", "modality", "created_at", "n_merged", _digest("description").alias("said"), _digest("source_ids").alias("keys"), F.array_join("file_paths", "|").alias("files"))


def cleanup_edges(spark, d):
    g = _slots(spark, d).edges
    return g.select("kb_id", "source", "target", "relation", "weight", "n_merged", "created_at", F.array_join("keywords", "|").alias("words"), _digest("description").alias("said"), _digest("source_ids").alias("keys"))


def cleanup_facts(spark, d):
    return C.fact_lists(C.projected(_slots(spark, d)).facts).select("kb_id", "name", "field", F.array_join("values", "|").alias("told"))


def cleanup_kept(spark, d):
    """Nodes and edges that the cleanup keeps before names are merged, by knowledge base."""
    g = C.projected(_slots(spark, d))
    one = lambda df, part: df.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(part))
    return one(g.nodes, "nodes").unionByName(one(g.edges, "edges"))


def _groups(g: C.Graph, name: str) -> DataFrame:
    eligible = g.nodes.filter(F.col("entity_type").isin(*O.mergeable_types))
    return written(C.alike_groups(similar_names(eligible, ALIKE), 12), name)


def _projected(spark, d, name: str) -> C.Graph:
    g = C.projected(_slots(spark, d))
    return C.Graph(written(g.nodes, f"{name}-n"), written(g.edges, f"{name}-e"), written(g.facts, f"{name}-f"))


def cleanup_canonical(spark, d):
    """The names that stand for groups of alike ones."""
    g = _projected(spark, d, "canonical")
    return C.chosen_names(g, _groups(g, "canonical-g"))


def _remapped(spark, d, name: str) -> tuple[C.Graph, DataFrame]:
    g = _projected(spark, d, name)
    return C.canonical_remap(g, written(C.chosen_names(g, _groups(g, f"{name}-g")), f"{name}-c"))


def cleanup_remapped(spark, d):
    g = _remapped(spark, d, "remapped")[0].nodes
    return g.select("kb_id", "name", "entity_type", "n_merged", F.array_join(F.sort_array("description"), "|").alias("said"), F.array_join(F.sort_array("source_ids"), "|").alias("keys"))


def cleanup_remapped_facts(spark, d):
    return C.fact_lists(_remapped(spark, d, "remapped")[0].facts).select("kb_id", "name", "field", F.array_join("values", "|").alias("told"))


def cleanup_counts(spark, d):
    return _remapped(spark, d, "counts")[1]


def shortest(kind: str, members: list[dict]) -> str:
    """A stand-in for a model that decides about names: the first of the shortest stands for all, surely."""
    names = sorted((m["name"] for m in members), key=lambda n: (len(n), n))
    return "```json\n" + json.dumps({"groups": [{"canonical": names[0], "members": names, "confidence": 0.95}, {"canonical": names[0], "members": names[:1], "confidence": 1}]}, ensure_ascii=False) + "\n```"


def cleanup_arbitrated(spark, d):
    """Names merged by a stand-in for a model among those that are alike, but not beyond doubt."""
    g = _projected(spark, d, "arbitrated")
    return C.arbitrated(C.gray_groups(g, ALIKE), shortest)


def cleanup_whole(spark, d):
    """The whole cleanup: nodes and edges left by knowledge base, and how many were absorbed."""
    g, counts = C.clean_graph(nodes(spark, d), edges(spark, d), ALIKE, name="whole")
    n = g.nodes.groupBy("kb_id").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(counts, "kb_id").select("kb_id", "n_nodes", "node_pairs", "edge_pairs")


def _chunked(df: DataFrame) -> DataFrame:
    """Records as extracted from a part of the text: that of the beginning of their first key, as few records here share a whole one."""
    return df.withColumn("chunk_id", F.substring(F.get(C.keys_of("source_ids"), F.lit(0)), 1, 7)).filter(F.col("chunk_id").isNotNull()).drop("kb_id")


def _pre(spark, d, typed: bool):
    return C.preprocessed(_chunked(nodes(spark, d)), _chunked(edges(spark, d)), typed=typed, name="preprocess")


def preprocess_nodes(spark, d):
    return _pre(spark, d, True)[0].select("chunk_id", "name", "entity_type", "modality", "n_merged")


def preprocess_facts(spark, d):
    return C.fact_lists(_pre(spark, d, True)[2].withColumnRenamed("chunk_id", "kb_id")).select(F.col("kb_id").alias("chunk_id"), "name", "field", F.array_join("values", "|").alias("told"))


def preprocess_edges(spark, d):
    return _pre(spark, d, True)[1].select("chunk_id", "edge_id", "source", "target", "relation")


def preprocess_plain_edges(spark, d):
    """Edges of the plainer mode, which keeps all types."""
    return _pre(spark, d, False)[1].select("chunk_id", "edge_id", "source", "target", "relation", F.md5(squeeze(F.col("description"))).alias("said"))


QUERIES = {f.__name__: f for f in (
    cleanup_entities, cleanup_slots, cleanup_edges, cleanup_facts, cleanup_kept, cleanup_canonical, cleanup_remapped, cleanup_remapped_facts, cleanup_counts, cleanup_arbitrated, cleanup_whole,
    preprocess_nodes, preprocess_facts, preprocess_edges, preprocess_plain_edges,
)}

_SPLIT = lambda c: f"list_filter(list_transform(string_split(coalesce({c}, ''), '<SEP>'), lambda x: trim(x)), lambda x: x <> '')"
_FLAT = "list_filter(flatten(list_transform(coalesce(source_ids, []), lambda s: list_transform(string_split(coalesce(s, ''), '<SEP>'), lambda x: trim(x)))), lambda x: x <> '')"
_FIRST = lambda c: f"list_filter({c}, lambda x, i: list_position({c}, x) = i)"
_EMPTY = lambda c: rf"(trim({c}) = '' or lower({SQUEEZE(c)}) in ('n/a', 'none', 'null', '{{}}'))"
_KEPT = _Q((*O.core_types, *O.anchor_types, O.multimodal_type))


def _graph(key: str) -> str:
    """CTEs of a graph whose nodes and edges are grouped by key: kb_id, or the chunk of the first key."""
    chunk = f"(list_filter(flatten(list_transform(coalesce(source_ids, []), lambda s: list_transform(string_split(coalesce(s, ''), '<SEP>'), lambda x: trim(x)))), lambda x: x <> ''))[1][1:7]"
    by = "kb_id" if key == "kb_id" else chunk
    drop = "" if key == "kb_id" else f" and not (consistent = '{O.multimodal_type}' and {_EMPTY('coalesce(description, chr(32))')})"
    return rf"""
, cn as (select node_id, any_value({by}) kb, any_value(id) id, any_value(entity_type) ty, any_value(description) description, any_value(source_ids) source_ids, any_value(file_path) file_path, any_value(attributes) attributes, any_value(created_at) created_at from graphnode where id is not null group by 1),
c0 as (select cn.*, t.consistent, t.nm, regexp_replace(regexp_extract(t.nm, '{_STAGE}', 1), '^{_MARKS}+|{_MARKS}+$', '', 'g') sb, regexp_extract(t.nm, '{_STAGE}', 2) sg from cn join t using (node_id) where {'true' if key == 'kb_id' else 'kb is not null'}),
c1 as (select *, case when consistent = '{O.staged_type}' and sg <> '' and sb <> '' and sb <> nm then sb else nm end as name,
  case when lower({SQUEEZE('ty')}) in ({_Q(O.modalities)}) then lower({SQUEEZE('ty')}) when regexp_extract(lower({SQUEEZE('id')}), '\((image|table|equation|header|page_number)\)\s*$', 1) <> '' then regexp_extract(lower({SQUEEZE('id')}), '\((image|table|equation|header|page_number)\)\s*$', 1)
    when contains(lower({SQUEEZE('id')}), 'page ') and contains(lower({SQUEEZE('id')}), 'number') then 'page_number' else '' end modality, {SQUEEZE('id')} typed from c0 where true{drop}),
c2 as (select *, {_SPLIT(SQUEEZE('description'))} l_said, {_FLAT} l_keys, {_SPLIT('file_path')} l_files from c1),
gn0 as (select kb, name, coalesce(arg_min(consistent, node_id) filter (consistent <> '{O.other_type}'), '{O.other_type}') entity_type, coalesce(arg_min(modality, node_id) filter (modality <> ''), '') modality, max(created_at) created_at, count(*) n_merged,
  flatten(list(l_said order by node_id)) said0, flatten(list(l_keys order by node_id)) ks0, flatten(list(l_files order by node_id)) files0 from c2 group by 1, 2),
gn as (select * exclude (said0, ks0, files0), {_FIRST('said0')} said, {_FIRST('ks0')} ks, {_FIRST('files0')} files from gn0),
gv as (select kb, id given, arg_max(name, node_id) as name from c1 group by 1, 2),
ce as (select edge_id, any_value({by}) kb, any_value(source) source, any_value(target) target, any_value(relation_type) relation_type, any_value(description) description, any_value(source_ids) source_ids, any_value(file_path) file_path, any_value(weight) weight, any_value(created_at) created_at from graphedge group by 1),
e1 as (select ce.* exclude (source, target), coalesce(a.name, source) source, coalesce(b.name, target) target from ce left join gv a on a.kb = ce.kb and a.given = source left join gv b on b.kb = ce.kb and b.given = target where {'true' if key == 'kb_id' else 'ce.kb is not null'}),
e2 as (select e1.*, coalesce(a.entity_type, '') st, coalesce(b.entity_type, '') tt, {SQUEEZE('e1.relation_type')} words, {SQUEEZE('e1.description')} d0, lower({SQUEEZE('e1.relation_type')} || ' ' || {SQUEEZE('e1.description')}) x from e1 left join gn a on a.kb = e1.kb and a.name = e1.source left join gn b on b.kb = e1.kb and b.name = e1.target),
e3 as (select *, {_ANY(O.alias_words, 'x')} alias, case {_LADDER(O.relation_words, 'x')} else '' end r, case when d0 = '' then 'N/A' else d0 end d from e2),
e4 as (select *, case when alias then '' when r in ('', '{O.always_allowed}') then r when st = '' or tt = '' then r when r not in ({_LISTED}) then r when r || '/' || st || '/' || tt in ({_PAIRS}) then r else '' end relation from e3),
own as (select kb, name, '{O.alias_field}' field, unnest(list_distinct([typed, nm])) v from c1 union select kb, name, unnest(map_keys(attributes)), trim(unnest(map_values(attributes))) from c1),
own2 as (select distinct kb, name, field, v from own where v is not null and v <> '' and not (field = '{O.alias_field}' and v = name and v in (select typed from c1 union select nm from c1)) ),
alf as (select kb, source as name, '{O.alias_field}' field, target v from e4 where alias and source <> target union select kb, target, '{O.alias_field}', source from e4 where alias and source <> target),
alf2 as (select alf.* from alf join gn using (kb, name) where v <> ''),
re as (select e4.* from e4 where relation <> '' and exists (select 1 from gn where gn.kb = e4.kb and gn.name = source) and exists (select 1 from gn where gn.kb = e4.kb and gn.name = target)),
re2 as (select *, {_SPLIT('d')} l_said, {_SPLIT('words')} l_words, {_FLAT} l_keys from re),
ge0 as (select kb, source, target, relation, max(weight) weight, max(created_at) created_at, count(*) n_merged, flatten(list(l_said order by edge_id)) said0, flatten(list(l_words order by edge_id)) ws0, flatten(list(l_keys order by edge_id)) ks0 from re2 group by 1, 2, 3, 4),
ge as (select * exclude (said0, ws0, ks0), {_FIRST('said0')} said, {_FIRST('ws0')} ws, {_FIRST('ks0')} ks from ge0),
kn as (select * from gn where entity_type in ({_KEPT}) and not (entity_type = '{O.multimodal_type}' and {_EMPTY("array_to_string(said, '<SEP>')")})),
ke as (select ge.* from ge where exists (select 1 from kn where kn.kb = ge.kb and kn.name = source) and exists (select 1 from kn where kn.kb = ge.kb and kn.name = target)),
"""


_VALUE = lambda name, said, edge: f"case when {SQUEEZE(said)} <> '' and length({SQUEEZE(said)}) >= length({name}) then {SQUEEZE(said)} when {SQUEEZE(edge)} <> '' and length({SQUEEZE(edge)}) >= length({name}) then {SQUEEZE(edge)} else {name} end"
_G = _N + _graph("kb_id") + rf"""
pj as (select x.kb, x.h as name, a.entity_type field, {_VALUE('a.name', "array_to_string(a.said, '<SEP>')", 'x.d')} v from (select kb, source a, target h, array_to_string(said, '<SEP>') d from ge union all select kb, target, source, array_to_string(said, '<SEP>') from ge) x
  join gn a on a.kb = x.kb and a.name = x.a and a.entity_type in ({_FIELDS}) join gn h on h.kb = x.kb and h.name = x.h and h.entity_type in ({_Q(O.attribute_hosts)})),
fa as (select distinct f.* from (select * from own2 union select * from alf2 union select * from pj) f join kn using (kb, name))"""
_S = _G.replace("fa as (", "fa as (").rstrip() + _ALIKE(ALIKE, "false").replace("from m where false", f"from (select kb kb_id, entity_type, name from kn where entity_type in ({_Q(O.mergeable_types)}))")
_COMPONENTS = lambda condition: rf"""
, un as (select kb_id, entity_type, a x, b y from sim where {condition} union select kb_id, entity_type, b, a from sim where {condition}),
rc as (with recursive r(kb_id, entity_type, x, y) as (select kb_id, entity_type, x, x from un union select r.kb_id, r.entity_type, r.x, un.y from r join un on un.kb_id = r.kb_id and un.entity_type = r.entity_type and un.x = r.y) select kb_id kb, entity_type, x as name, min(y) grp from r group by 1, 2, 3),
gr as (select * from rc where (kb, entity_type, grp) in (select (kb, entity_type, grp) from rc group by kb, entity_type, grp having count(*) between 2 and 12))"""  # noqa: E731
_MERGED = rf"""
, tl as (select kb, name, count(*) filter (field = '{O.alias_field}') + count(distinct field) told from fa group by 1, 2),
sc as (select gr.*, (regexp_matches(gr.name, '[\x{{4e00}}-\x{{9fff}}]')::int, coalesce(told, 0), coalesce(least(length(array_to_string(said, '<SEP>')), 300), 0), -length(gr.name), gr.name) s from gr left join tl using (kb, name) left join kn using (kb, name)),
cm as (select gr.kb, gr.name, b.canonical from gr join (select kb, entity_type, grp, arg_max(name, s) canonical from sc group by 1, 2, 3) b using (kb, entity_type, grp)),
to_ as (select * from cm where name <> canonical),
rn as (select kn.*, coalesce(canonical, kn.name) nn, (canonical is not null)::int moved from kn left join to_ using (kb, name)),
nn as (select kb, nn as name, arg_min(entity_type, (moved, name)) entity_type, sum(n_merged)::bigint n_merged, list_sort(list_distinct(flatten(list(said)))) said, list_sort(list_distinct(flatten(list(ks)))) ks, count(*) here from rn group by 1, 2),
rr as (select ke.kb, coalesce(a.canonical, source) s, coalesce(b.canonical, target) t, relation from ke left join to_ a on a.kb = ke.kb and a.name = source left join to_ b on b.kb = ke.kb and b.name = target),
ne as (select kb, s, t, relation, count(*) here from rr where s <> t group by 1, 2, 3, 4),
ct as (select kb, sum(a)::bigint node_pairs, sum(b)::bigint edge_pairs from (select kb, here - 1 a, 0 b from nn union all select kb, 0, here - 1 from ne) group by 1)"""
_CANON = _S + _COMPONENTS("true") + _MERGED
_P = _N + _graph("chunk") + rf"""
pj as (select x.kb, x.h as name, a.entity_type field, {_VALUE('a.name', "array_to_string(a.said, '<SEP>')", 'x.d')} v from (select kb, source a, target h, d from e4 where not alias union all select kb, target, source, d from e4 where not alias) x
  join gn a on a.kb = x.kb and a.name = x.a and a.entity_type in ({_FIELDS}) join gn h on h.kb = x.kb and h.name = x.h and h.entity_type in ({_Q(O.attribute_hosts)})),
kp as (select * from gn where entity_type in ({_KEPT})),
pe as (select e4.* from e4 where relation in ({_Q(O.relations)}) and exists (select 1 from kp where kp.kb = e4.kb and kp.name = source) and exists (select 1 from kp where kp.kb = e4.kb and kp.name = target)),
ef as (select pe.kb, source as name, case {_LADDER(O.attribute_words, "lower(relation || ' ' || words || ' ' || d)")} else '' end field, {SQUEEZE('d')} v from pe join kp on kp.kb = pe.kb and kp.name = source where kp.entity_type in ({_Q(O.attribute_hosts)})),
fa as (select distinct f.* from (select * from own2 union select * from alf2 union select * from pj union select * from ef where field <> '' and v <> '') f join kp using (kb, name))"""
_TOLD = "select {0}, name, field, array_to_string(list_sort(list(v)), '|') told from (select distinct kb, name, field, v from {1}) group by kb, name, field"
ORACLE_SQL = {
    "cleanup_entities": _G + " select node_id, name, consistent entity_type, modality, array_to_string(list_filter(case when name <> nm then [nm] else [] end, lambda a: a <> name), '|') aliases from c1",
    "cleanup_slots": _G + " select kb kb_id, name, entity_type, modality, created_at, n_merged, md5(array_to_string(said, '|')) said, md5(array_to_string(ks, '|')) keys, array_to_string(files, '|') files from gn",
    "cleanup_edges": _G + " select kb kb_id, source, target, relation, weight, n_merged, created_at, array_to_string(ws, '|') words, md5(array_to_string(said, '|')) said, md5(array_to_string(ks, '|')) keys from ge",
    "cleanup_facts": _G + " " + _TOLD.format("kb kb_id", "fa"),
    "cleanup_kept": _G + " select kb kb_id, 'nodes' part, count(*) n from kn group by 1 union all select kb, 'edges', count(*) from ke group by 1",
    "cleanup_canonical": _CANON + " select kb kb_id, name, canonical from cm",
    "cleanup_remapped": _CANON + " select kb kb_id, name, entity_type, n_merged, array_to_string(said, '|') said, array_to_string(ks, '|') keys from nn",
    "cleanup_remapped_facts": _CANON + f", mf as (select f.kb, coalesce(t.canonical, f.name) as name, f.field, f.v from fa f left join to_ t on t.kb = f.kb and t.name = f.name), af as (select * from mf where not (field = '{O.alias_field}' and v = name) union select kb, canonical, '{O.alias_field}', name from to_) " + _TOLD.format("kb kb_id", "af"),
    "cleanup_counts": _CANON + " select kb kb_id, node_pairs, edge_pairs from ct",
    "cleanup_whole": _S + _COMPONENTS("similarity >= 0.92") + _MERGED + " select kb kb_id, n_nodes, node_pairs, edge_pairs from (select kb, count(*) n_nodes from nn group by 1) join ct using (kb)",
    "cleanup_arbitrated": _S + _COMPONENTS("similarity < 0.92") + " select kb kb_id, name, first(name) over (partition by kb, entity_type, grp order by length(name), name) canonical from gr",
    "preprocess_nodes": _P + " select kb chunk_id, name, entity_type, modality, n_merged from kp",
    "preprocess_facts": _P + " " + _TOLD.format("kb chunk_id", "fa"),
    "preprocess_edges": _P + " select kb chunk_id, edge_id, source, target, relation from pe",
    "preprocess_plain_edges": _P + f" select kb chunk_id, edge_id, source, target, relation, md5({SQUEEZE('d')}) said from e4 where relation <> ''",
}
