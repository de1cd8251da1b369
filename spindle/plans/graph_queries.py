"""Queries over the knowledge graph and retrieval, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.functions.ontology import DEFAULT as O
from spindle.functions.text import any_of, attribute_field, bigram_cosine, compare_name, consistent_type, entity_name, entity_type, has_cjk, is_alias, modality_of, relation_of, squeeze, stage_parts, without_suffix
from spindle.functions.udfs import sequence_ratio
from spindle.operators import graph as G, retrieval as R
from spindle.operators.records import first_version, latest_version
from spindle.plans.block_queries import SQUEEZE
from spindle.session import table, written


def nodes(spark: SparkSession, d: str) -> DataFrame:
    return first_version(table(spark, d, "graphnode").select("node_id", "kb_id", "id", "entity_type", "description", "source_ids", "ingested_at"), "node_id").filter(F.col("id").isNotNull())


def edges(spark: SparkSession, d: str) -> DataFrame:
    return first_version(table(spark, d, "graphedge").select("edge_id", "kb_id", "source", "target", "relation_type", "description", "source_ids", "weight", "ingested_at"), "edge_id")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """The standing version of each chunk."""
    c = table(spark, d, "chunks").select("chunk_id", "content", "page_idx", "file_path", "tokens", "is_deleted", "ingested_at")
    return latest_version(c, "chunk_id").filter(~F.coalesce("is_deleted", F.lit(False)))


def graph_names(spark, d):
    n = nodes(spark, d)
    c = F.concat(F.lit(" "), F.col("id"), F.lit("　(image) "))
    return n.select("node_id", squeeze(c).alias("squeezed"), without_suffix(c).alias("plain"), compare_name(F.col("id")).alias("compare"), has_cjk(F.col("id")).alias("cjk"), modality_of(c, F.col("entity_type")).alias("modality"))


def graph_keys(spark, d):
    return nodes(spark, d).select("node_id", F.explode(G.keys_of("source_ids")).alias("chunk_id"))


def graph_stages(spark, d):
    n = nodes(spark, d).select("node_id", F.explode(F.array(F.concat("id", F.lit("成虫")), F.concat("id", F.lit("（低龄幼虫）")), F.concat("id", F.lit(" 3龄幼虫")), F.col("id"))).alias("name"))
    return n.select("node_id", "name", stage_parts(F.col("name")).alias("p")).select("node_id", "name", "p.base", "p.stage")


def graph_types(spark, d):
    n = nodes(spark, d)
    return n.select("node_id", entity_type(F.col("entity_type")).alias("allowed"), consistent_type(F.col("id"), F.col("entity_type")).alias("consistent"))


def _merged(spark, d):
    return G.merge_nodes(nodes(spark, d), "node_id")


def graph_merged_nodes(spark, d):
    return _merged(spark, d).select("kb_id", "name", "entity_type", "description", F.array_join("source_ids", ",").alias("keys"), "n_merged")


def _related(spark, d):
    return G.mapped_relations(edges(spark, d), _merged(spark, d).select("kb_id", "name", "entity_type"))


def graph_relations(spark, d):
    e = _related(spark, d)
    return e.select("edge_id", "source_type", "target_type", "relation", relation_of(F.col("relation_type"), F.col("description")).alias("named"),
                    is_alias(F.col("relation_type"), F.col("description")).alias("alias"), attribute_field(F.col("relation_type"), F.lit(""), F.col("description")).alias("field"))


def graph_merged_edges(spark, d):
    m = G.merge_edges(_related(spark, d).filter(F.col("relation") != ""), "edge_id")
    return m.select("kb_id", "source", "target", "relation", "weight", "description", F.array_join("source_ids", ",").alias("keys"), "n_merged")


def graph_remapped_edges(spark, d):
    """Edges whose ends take the first name of their kb that is equal but for marks and case."""
    n = nodes(spark, d).select("kb_id", F.col("id").alias("name"), F.lower(compare_name(F.col("id"))).alias("k")).distinct()
    names = n.join(n.groupBy("kb_id", "k").agg(F.min("name").alias("canonical")), ["kb_id", "k"]).select("kb_id", "name", "canonical")
    return G.remap(edges(spark, d), names).groupBy("kb_id", "source", "target").agg(F.count(F.lit(1)).alias("n"))


def graph_attributes(spark, d):
    return G.project_attributes(_merged(spark, d), edges(spark, d))


def graph_clean_edges(spark, d):
    kept = G.kept_nodes(_merged(spark, d))
    return G.with_both_ends(_related(spark, d).filter(F.col("relation") != ""), kept).select("edge_id", "kb_id", "source", "target", "relation")


def graph_summary(spark, d):
    return G.graph_report(_merged(spark, d), _related(spark, d))


def graph_degrees(spark, d):
    return G.incident(edges(spark, d)).groupBy("kb_id", "name").agg(F.count(F.lit(1)).alias("degree"), F.countDistinct("other").alias("n_neighbours"))


def graph_similar_names(spark, d):
    s = G.similar_names(_merged(spark, d), 0.8)
    return s.select("kb_id", "entity_type", "a", "b", F.round("similarity", 6).alias("similarity"))


def graph_name_cosines(spark, d):
    """Bigram cosine of each name with what is left of it without marks, and with its base without a stage of life."""
    n = nodes(spark, d).select("id").distinct()
    c = lambda other: F.round(bigram_cosine(F.col("id"), other), 6)
    return n.select("id", c(compare_name(F.col("id"))).alias("plain"), c(stage_parts(F.col("id"))["base"]).alias("base"))


def graph_name_ratios(spark, d):
    """Sequence ratio of each name to its base read backwards."""
    n = nodes(spark, d).select("id").distinct().withColumn("back", F.reverse(stage_parts(F.col("id"))["base"]))
    return n.select("id", F.round(sequence_ratio("id", "back"), 6).alias("ratio"))


def graph_components(spark, d):
    e = edges(spark, d)
    return G.components(e.select(F.concat_ws("/", "kb_id", "source").alias("a"), F.concat_ws("/", "kb_id", "target").alias("b")).filter(F.col("source").isNotNull() & F.col("target").isNotNull() & F.col("kb_id").isNotNull()))


def _pack_chunks(spark, d):
    return table(spark, d, "evidencepack").select(F.explode("evidence.chunk_id").alias("chunk_id")).filter(F.col("chunk_id").isNotNull()).distinct()


def graph_subgraph_nodes(spark, d):
    return G.subgraph(nodes(spark, d), edges(spark, d), _pack_chunks(spark, d))[0].select("kb_id", "node_id")


def graph_subgraph_edges(spark, d):
    return G.subgraph(nodes(spark, d), edges(spark, d), _pack_chunks(spark, d))[1].select("kb_id", "edge_id")


def graph_focus_nodes(spark, d):
    return G.focused_subgraph(nodes(spark, d), edges(spark, d), _pack_chunks(spark, d).filter(F.col("chunk_id") < "chunk-3"))[0]


def graph_focus_edges(spark, d):
    return G.focused_subgraph(nodes(spark, d), edges(spark, d), _pack_chunks(spark, d).filter(F.col("chunk_id") < "chunk-3"))[1]


def graph_whole_view(spark, d):
    """All of the graph, with the share of nodes that is highlighted."""
    n, e = G.focused_subgraph(nodes(spark, d), edges(spark, d), _pack_chunks(spark, d), whole=True)
    both = n.select("kb_id", "highlighted", F.lit("nodes").alias("part")).unionByName(e.select("kb_id", "highlighted", F.lit("edges").alias("part")))
    return both.groupBy("kb_id", "part").agg(F.count(F.lit(1)).alias("n"), F.count_if("highlighted").alias("n_highlighted"))


def _hits(spark, d):
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    return written(R.vector_top_k(q, e, 10, exclude_own=True), "hits")


def search_top_k(spark, d):
    return _hits(spark, d).select("query_id", "vec_id", F.round("score", 5).alias("score"), "rank")


def _entity_hits(spark, d):
    """Vectors stand for nodes of the same number."""
    return _hits(spark, d).join(nodes(spark, d).select(F.col("node_id").alias("vec_id"), "kb_id", F.col("id").alias("name"), "source_ids"), "vec_id")


def _edge_hits(spark, d):
    return _hits(spark, d).select("query_id", F.col("vec_id").alias("edge_id"), "rank").join(edges(spark, d).select("edge_id"), "edge_id", "left_semi")


def search_local(spark, d):
    return R.local_context(_entity_hits(spark, d).select("query_id", "kb_id", "name", "rank"), edges(spark, d))


def search_global(spark, d):
    return R.global_context(_edge_hits(spark, d), edges(spark, d))


def search_hybrid(spark, d):
    item = F.concat_ws("/", "kb_id", "name").alias("item")
    local = _entity_hits(spark, d).groupBy("query_id", "kb_id", "name").agg(F.min("rank").alias("rank")).select("query_id", item, "rank")
    return R.round_robin([local, search_global(spark, d).select("query_id", item, "rank")], "item")


def search_chunks(spark, d):
    h = _entity_hits(spark, d).withColumn("source_ids", G.keys_of("source_ids"))
    return R.by_weight(h.select("query_id", "source_ids", "rank"))


def search_context(spark, d):
    """The chunks found for each query, in order, within a budget of characters."""
    text = search_chunks(spark, d).join(chunks(spark, d).select("chunk_id", "content"), "chunk_id")
    return R.within_budget(text, "query_id", "rank", "content", 600).select("query_id", "chunk_id", "rank", F.length("content").alias("n_chars"))


def search_citations(spark, d):
    """Chunk ids in the notes and contexts of packs, as citations."""
    p = first_version(table(spark, d, "evidencepack").select("pack_id", "evidence", "ingested_at"), "pack_id")
    answers = p.select(F.col("pack_id").alias("answer_id"), F.array_join(F.transform("evidence", lambda e: F.concat(F.lit("see "), F.coalesce(e["chunk_id"], F.lit("")))), "; ").alias("text"))
    return R.citations(answers, chunks(spark, d)).select("answer_id", "chunk_id", "page_idx", F.length("snippet").alias("n_chars"))


QUERIES = {f.__name__: f for f in (
    graph_names, graph_keys, graph_stages, graph_types, graph_merged_nodes, graph_relations, graph_merged_edges, graph_remapped_edges, graph_attributes, graph_clean_edges, graph_summary,
    graph_degrees, graph_similar_names, graph_name_cosines, graph_name_ratios, graph_components, graph_subgraph_nodes, graph_subgraph_edges, graph_focus_nodes, graph_focus_edges, graph_whole_view, search_top_k, search_local, search_global, search_hybrid,
    search_chunks, search_context, search_citations,
)}

_Q = lambda words: ",".join(f"'{w}'" for w in words)
_TYPES, _FIELDS = _Q(O.entity_types), _Q(O.attribute_fields)
_ANY = lambda words, x="x": f"regexp_matches({x}, '" + "|".join(words) + "')"
_LADDER = lambda rows, x: " ".join(f"when {_ANY(words, x)} then '{name}'" for name, words in rows)
_LISTED = _Q(sorted({p[0] for p in O.pairs}))
_PAIRS = _Q("/".join(p) for p in O.pairs)
_MARKS = any_of(O.name_marks)
_STAGE = rf"^(.+?)[\s\-_/]*[（(【\[]?({'|'.join(sorted(O.stages, key=len, reverse=True))}|{O.stage_pattern})[）)】\]]?$"
_PLAIN = lambda c: rf"regexp_replace({c}, '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g')"
_N = rf"""with n as (select distinct node_id, kb_id, id, entity_type, description, source_ids from graphnode where id is not null),
e as (select distinct edge_id, kb_id, source, target, relation_type, description, source_ids, weight from graphedge),
nk as (select node_id, i, j, trim(p[j]) k from (select node_id, i, string_split(source_ids[i], '<SEP>') p, unnest(range(1, len(string_split(source_ids[i], '<SEP>')) + 1)) j from (select node_id, source_ids, unnest(range(1, len(source_ids) + 1)) i from n)) where trim(p[j]) <> ''),
ek as (select edge_id, i, j, trim(p[j]) k from (select edge_id, i, string_split(source_ids[i], '<SEP>') p, unnest(range(1, len(string_split(source_ids[i], '<SEP>')) + 1)) j from (select edge_id, source_ids, unnest(range(1, len(source_ids) + 1)) i from e)) where trim(p[j]) <> ''),
t0 as (select *, case when lower({SQUEEZE('entity_type')}) in ('image','table','equation','header','page_number') then '多模态元素' when {SQUEEZE('entity_type')} in ({_TYPES}) then {SQUEEZE('entity_type')} else '其他' end allowed,
  regexp_replace({SQUEEZE("regexp_replace(" + SQUEEZE('id') + ", '(?i)" + chr(92) + "s*" + chr(92) + "((image|table|equation|header|page_number|other)" + chr(92) + ")" + chr(92) + "s*$', '')")}, '^{_MARKS}+|{_MARKS}+$', '', 'g') nm0 from n),
t1 as (select *, case when nm0 = '' then '{O.nameless}' else nm0 end nm from t0),
t2 as (select *, case when not regexp_matches(nm, '[\x{{4e00}}-\x{{9fff}}]') and regexp_matches(nm, '[A-Za-z]{{2,}}') and allowed not in ('{O.other_type}', '{O.multimodal_type}', {_FIELDS}) then '{O.other_type}' else allowed end a2 from t1),
t as (select *, case when a2 in ({_Q(O.protected_types)}) then a2
  when nm in ({_Q(O.plant_parts)}) or nm like '%{O.part_ending}' or (length(nm) <= 4 and regexp_matches(nm, '{O.part_letters}')) then '部位'
  when a2 in ('作物','生物分类','其他') and (nm in ({_Q(O.crop_groups)}) or regexp_matches(nm, '{O.taxonomy_pattern}') or regexp_matches(nm, '{O.composite_pattern}') or {_ANY(O.group_words, 'nm')} or (length(nm) >= 3 and regexp_matches(nm, '{O.group_pattern}'))) then '生物分类' else a2 end consistent from t2),
m as (select kb_id, nm as name, coalesce(arg_min(consistent, node_id) filter (consistent <> '其他'), '其他') entity_type, coalesce(arg_min({SQUEEZE('description')}, node_id) filter ({SQUEEZE('description')} <> ''), '') description, count(*) n_merged from t group by 1, 2),
et as (select e.*, coalesce(a.entity_type, '') source_type, coalesce(b.entity_type, '') target_type, lower(coalesce(relation_type, '') || ' ' || coalesce(e.description, '')) x,
  lower(concat_ws(' ', relation_type, e.description)) y from e left join m a on a.kb_id = e.kb_id and a.name = e.source left join m b on b.kb_id = e.kb_id and b.name = e.target),
en as (select *, case {_LADDER(O.relation_words, 'x')} else '' end named from et),
er as (select *, case when named in ('', '{O.always_allowed}') then named when source_type = '' or target_type = '' then named when named not in ({_LISTED}) then named
  when named || '/' || source_type || '/' || target_type in ({_PAIRS}) then named else '' end relation from en),
pc as (select distinct unnest(evidence).chunk_id k from evidencepack),
eh as (select distinct e.* from e join ek using (edge_id) join pc using (k)),
nh as (select distinct kb_id, id as name from n join nk using (node_id) join pc using (k) union select kb_id, source from eh union select kb_id, target from eh),
ch as (select chunk_id, arg_max(content, ingested_at) content, arg_max(page_idx, ingested_at) page_idx, arg_max(coalesce(is_deleted, false), ingested_at) gone from chunks group by 1),
hits as (select query_id, vec_id, score, rank from (select query_id, vec_id, score, row_number() over (partition by query_id order by score desc, vec_id) rank from (
  select q.vec_id query_id, v.vec_id, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) score from embeddings q, embeddings v where q.vec_id % 20 = 0 and v.vec_id <> q.vec_id) where score >= 0.2) where rank <= 10),
hn as (select h.*, n.kb_id, n.id as name, n.node_id from hits h join n on n.node_id = h.vec_id),
gl as (select query_id, kb_id, name, min(rank) rank from (select h.query_id, e.kb_id, e.source as name, rank from hits h join e on e.edge_id = h.vec_id union all select h.query_id, e.kb_id, e.target, rank from hits h join e on e.edge_id = h.vec_id) group by 1, 2, 3),
cw as (select query_id, k chunk_id, n, rank from (select query_id, k, count(*) n, min(rank) best, row_number() over (partition by query_id order by count(*) desc, min(rank), k) rank from (select distinct query_id, rank, vec_id, k from hn join nk using (node_id)) group by 1, 2))
"""
_FOCUS = _N + """, p3 as (select k from pc where k < 'chunk-3'), h1 as (select n.*, node_id in (select node_id from nk join p3 using (k)) highlighted from n), h2 as (select e.*, edge_id in (select edge_id from ek join p3 using (k)) highlighted from e),
na as (select kb_id, id as name from h1 where highlighted union select kb_id, source from h2 where highlighted union select kb_id, target from h2 where highlighted), tk as (select kb_id from h1 where highlighted and kb_id is not null union select kb_id from h2 where highlighted and kb_id is not null),
fn as (select * from (select h1.kb_id, node_id, highlighted, row_number() over (partition by h1.kb_id order by node_id) r from h1 join na on na.kb_id = h1.kb_id and na.name = h1.id) where r <= 180),
pn as (select * from (select kb_id, id, node_id, highlighted, row_number() over (partition by kb_id order by node_id) r from h1 where kb_id is null or kb_id not in (select kb_id from tk)) where r <= 180),
ce as (select kb_id, edge_id, highlighted from h2 where highlighted union all select kb_id, edge_id, highlighted from h2 where (kb_id is null or kb_id not in (select kb_id from tk)) and exists (select 1 from pn where pn.kb_id = h2.kb_id and pn.id = source) and exists (select 1 from pn where pn.kb_id = h2.kb_id and pn.id = target)),
fe as (select * from (select *, row_number() over (partition by kb_id order by edge_id) r from ce) where r <= 360)
"""
# matching blocks of ab (id, ka, kb): the longest common block of two names, the earliest in the first, then in the second, and again on both sides of it
_BLOCKS = """ij as (select id, ka, kb, i, unnest(range(0, length(kb))) j from (select id, ka, kb, unnest(range(0, length(ka))) i from ab)),
tri as (select id, i, j, k from (select id, ka, kb, i, j, unnest(range(1, least(length(ka) - i, length(kb) - j) + 1)) k from ij where ka[i + 1] = kb[j + 1]) where ka[i + 1:i + k] = kb[j + 1:j + k]),
bl as (with recursive seg(id, alo, ahi, blo, bhi, got) as (select id, 0::bigint, length(ka)::bigint, 0::bigint, length(kb)::bigint, 0::bigint from ab
  union all select id, u.alo, u.ahi, u.blo, u.bhi, u.got from (select id, unnest([{'alo': alo, 'ahi': -b.i, 'blo': blo, 'bhi': -b.j, 'got': b.k}, {'alo': -b.i + b.k, 'ahi': ahi, 'blo': -b.j + b.k, 'bhi': bhi, 'got': 0}]) u
    from (select s.id, alo, ahi, blo, bhi, max({'k': t.k, 'i': -t.i, 'j': -t.j}) b from seg s join tri t on t.id = s.id and t.i >= alo and t.i + t.k <= ahi and t.j >= blo and t.j + t.k <= bhi group by all)))
  select id, sum(got) got from seg group by 1),"""
_ALIKE = lambda least, where="true": rf"""
, nm as (select distinct kb_id, entity_type, name, {_PLAIN('name')} k from m where {where}),
g2 as (select name, g, count(*) c from (select name, unnest(case when length(k) > 1 then list_transform(range(1, length(k)), lambda i: k[i:i + 1]) else [k] end) g from (select distinct name, k from nm where k <> '')) group by 1, 2),
no as (select name, sqrt(sum(c * c)) s from g2 group by 1),
pr as (select row_number() over () id, x.kb_id, x.entity_type, x.name a, y.name b, x.k ka, y.k kb from nm x join nm y on y.kb_id = x.kb_id and y.entity_type = x.entity_type and x.name < y.name where x.k <> '' and y.k <> ''),
ab as (select row_number() over () id, ka, kb from (select distinct ka, kb from pr where len(list_intersect(list_distinct(string_split(ka, '')), list_distinct(string_split(kb, '')))) > 0)),
{_BLOCKS}
co as (select x.name a, y.name b, sum(x.c * y.c) d from g2 x join g2 y using (g) where x.name < y.name group by 1, 2),
si as (select pr.kb_id, pr.entity_type, pr.a, pr.b, case when pr.ka = pr.kb then 1.0 else greatest(2.0 * coalesce(bl.got, 0) / (length(pr.ka) + length(pr.kb)), coalesce(co.d, 0) / (p.s * q.s)) end similarity
  from pr left join ab on ab.ka = pr.ka and ab.kb = pr.kb left join bl on bl.id = ab.id left join co on co.a = pr.a and co.b = pr.b join no p on p.name = pr.a join no q on q.name = pr.b),
sim as (select * from si where similarity >= {least})
"""  # noqa: E731
ORACLE_SQL = {
    "graph_name_ratios": _N + f""", i0 as (select distinct id, {SQUEEZE('id')} s from n), i1 as (select id, case when regexp_extract(s, '{_STAGE}', 2) <> '' and regexp_replace(regexp_extract(s, '{_STAGE}', 1), '^{_MARKS}+|{_MARKS}+$', '', 'g') <> '' then regexp_replace(regexp_extract(s, '{_STAGE}', 1), '^{_MARKS}+|{_MARKS}+$', '', 'g') else s end b from i0),
      ab as (select id, id ka, reverse(b) kb from i1), {_BLOCKS} fin as (select 1) select ab.id, round(2.0 * coalesce(got, 0) / greatest(length(ka) + length(kb), 1), 6) ratio from ab left join bl on bl.id = ab.id""",
    "graph_similar_names": _N + _ALIKE(0.8) + "select kb_id, entity_type, a, b, round(similarity, 6) similarity from sim",
    "graph_name_cosines": _N + rf""", i0 as (select distinct id, {SQUEEZE('id')} s from n), i1 as (select id, {_PLAIN('id')} p, case when regexp_extract(s, '{_STAGE}', 2) <> '' and regexp_replace(regexp_extract(s, '{_STAGE}', 1), '^{_MARKS}+|{_MARKS}+$', '', 'g') <> '' then regexp_replace(regexp_extract(s, '{_STAGE}', 1), '^{_MARKS}+|{_MARKS}+$', '', 'g') else s end b from i0),
      w as (select id, unnest(['id', 'plain', 'base']) which, unnest([id, p, b]) t from i1), g as (select id, which, g, count(*) c from (select id, which, unnest(case when length(t) > 1 then list_transform(range(1, length(t)), lambda i: t[i:i + 1]) when length(t) = 1 then [t] else [] end) g from w) group by 1, 2, 3),
      no as (select id, which, sqrt(sum(c * c)) n from g group by 1, 2), d as (select x.id, y.which, sum(x.c * y.c) d from g x join g y on y.id = x.id and y.g = x.g where x.which = 'id' group by 1, 2)
      select i1.id, round(coalesce(max(d.d / (a.n * z.n)) filter (d.which = 'plain'), 0), 6) plain, round(coalesce(max(d.d / (a.n * z.n)) filter (d.which = 'base'), 0), 6) base from i1 left join no a on a.id = i1.id and a.which = 'id' left join d on d.id = i1.id and d.which <> 'id' left join no z on z.id = i1.id and z.which = d.which group by 1""",
    "graph_names": _N + rf"""select node_id, {SQUEEZE("' ' || id || '　(image) '")} squeezed, regexp_replace({SQUEEZE("' ' || id || '　(image) '")}, '(?i)\s*\((image|table|equation|header|page_number|other)\)\s*$', '') plain,
      regexp_replace(id, '[^\x{{4e00}}-\x{{9fff}}A-Za-z0-9]', '', 'g') compare, regexp_matches(id, '[\x{{4e00}}-\x{{9fff}}]') cjk, case when lower({SQUEEZE('entity_type')}) in ('image','table','equation','header','page_number') then lower({SQUEEZE('entity_type')}) else 'image' end modality from n""",
    "graph_keys": _N + "select distinct node_id, k chunk_id from nk",
    "graph_stages": _N + rf""", v as (select node_id, unnest([id || '成虫', id || '（低龄幼虫）', id || ' 3龄幼虫', id]) as name from n), x as (select node_id, name, {SQUEEZE('name')} s from v),
      y as (select *, regexp_replace(regexp_extract(s, '{_STAGE}', 1), '^{_MARKS}+|{_MARKS}+$', '', 'g') b, regexp_extract(s, '{_STAGE}', 2) g from x) select node_id, name, case when g <> '' and b <> '' then b else s end base, case when b <> '' then g else '' end stage from y""",
    "graph_types": _N + "select node_id, allowed, consistent from t",
    "graph_merged_nodes": _N + ", o as (select t.kb_id, t.nm as name, nk.k, min(t.node_id * 1000000 + nk.i * 1000 + nk.j) o from t join nk using (node_id) group by 1, 2, 3), ks as (select kb_id, name, string_agg(k, ',' order by o) keys from o group by 1, 2) select m.kb_id, m.name, entity_type, description, coalesce(keys, '') keys, n_merged from m left join ks on ks.kb_id is not distinct from m.kb_id and ks.name = m.name",
    "graph_relations": _N + f"select edge_id, source_type, target_type, relation, named, {_ANY(O.alias_words, 'y')} alias, case {_LADDER(O.attribute_words, 'z')} else '' end field from (select *, lower(coalesce(relation_type, '') || '  ' || coalesce(description, '')) z from er)",
    "graph_merged_edges": _N + f", k as (select * from er where relation <> ''), o as (select kb_id, source, target, relation, ek.k, min(edge_id * 1000000 + i * 1000 + j) o from k join ek using (edge_id) group by 1, 2, 3, 4, 5), ks as (select kb_id, source, target, relation, string_agg(k, ',' order by o) keys from o group by 1, 2, 3, 4), g as (select kb_id, source, target, relation, max(weight) weight, coalesce(arg_min({SQUEEZE('description')}, edge_id) filter ({SQUEEZE('description')} <> ''), 'N/A') description, count(*) n_merged from k group by 1, 2, 3, 4) select g.*, coalesce(keys, '') keys from g left join ks on ks.kb_id is not distinct from g.kb_id and ks.source is not distinct from g.source and ks.target is not distinct from g.target and ks.relation = g.relation",
    "graph_remapped_edges": _N + r", q as (select distinct kb_id, id as name, lower(regexp_replace(id, '[^\x{4e00}-\x{9fff}A-Za-z0-9]', '', 'g')) k from n), c as (select kb_id, k, min(name) canonical from q group by 1, 2), nm as (select q.kb_id, q.name, canonical from q join c on c.kb_id = q.kb_id and c.k = q.k), r as (select e.kb_id, coalesce(a.canonical, e.source) source, coalesce(b.canonical, e.target) target from e left join nm a on a.kb_id = e.kb_id and a.name = e.source left join nm b on b.kb_id = e.kb_id and b.name = e.target) select kb_id, source, target, count(*) n from r where source <> target group by 1, 2, 3",
    "graph_attributes": _N + f", b as (select kb_id, source a, target h, description d from e union all select kb_id, target, source, description from e) select distinct b.kb_id, b.h host, x.entity_type field, case when x.description <> '' and length(x.description) >= length(x.name) then x.description when {SQUEEZE('b.d')} <> '' and length({SQUEEZE('b.d')}) >= length(x.name) then {SQUEEZE('b.d')} else x.name end as value from b join m x on x.kb_id = b.kb_id and x.name = b.a and x.entity_type in ({_FIELDS}) join m y on y.kb_id = b.kb_id and y.name = b.h and y.entity_type in ({_Q(O.attribute_hosts)})",
    "graph_clean_edges": _N + f", k as (select kb_id, name from m where entity_type in ({_Q((*O.core_types, *O.anchor_types, O.multimodal_type))})) select edge_id, er.kb_id, source, target, relation from er where relation <> '' and exists (select 1 from k where k.kb_id = er.kb_id and k.name = er.source) and exists (select 1 from k where k.kb_id = er.kb_id and k.name = er.target)",
    "graph_summary": _N + r"select kb_id, 'entity_type' part, entity_type as name, count(*) n from m group by 1, 3 union all select kb_id, 'relation', relation, count(*) from er group by 1, 3 union all select kb_id, 'script', case when regexp_matches(name, '[\x{4e00}-\x{9fff}]') then 'cjk' else 'other' end, count(*) from m group by 1, 3",
    "graph_degrees": _N + ", i as (select kb_id, source as name, target other, edge_id from e union all select kb_id, target, source, edge_id from e where source <> target) select kb_id, name, count(*) degree, count(distinct other) n_neighbours from i group by 1, 2",
    "graph_components": """with recursive e as (select distinct kb_id || '/' || source a, kb_id || '/' || target b from graphedge where source is not null and target is not null and kb_id is not null and source <> target),
      u as (select a, b from e union select b, a from e), r(node, seen) as (select a, a from u union select r.node, u.b from r join u on u.a = r.seen)
      select node, min(seen) component from r group by 1""",
    "graph_subgraph_nodes": _N + "select kb_id, node_id from (select n.kb_id, n.node_id, row_number() over (partition by n.kb_id order by n.node_id) r from n join nh on nh.kb_id = n.kb_id and nh.name = n.id) where r <= 180",
    "graph_subgraph_edges": _N + "select kb_id, edge_id from (select kb_id, edge_id, row_number() over (partition by kb_id order by edge_id) r from eh) where r <= 360",
    "graph_focus_nodes": _FOCUS + "select kb_id, node_id, highlighted from fn union all select kb_id, node_id, highlighted from pn",
    "graph_focus_edges": _FOCUS + "select kb_id, edge_id, highlighted from fe",
    "graph_whole_view": _N + ", hn2 as (select distinct node_id from nk join pc using (k)), a as (select kb_id, 'nodes' part, node_id in (select node_id from hn2) h from n union all select kb_id, 'edges', edge_id in (select edge_id from eh) from e) select kb_id, part, count(*) n, count(*) filter (h) n_highlighted from a group by 1, 2",
    "search_top_k": _N + "select query_id, vec_id, round(score, 5) score, rank from hits",
    "search_local": _N + ", x as (select h.query_id, e.edge_id, min(rank) hit, max(e.weight) w from hn h join e on e.kb_id = h.kb_id and (e.source = h.name or e.target = h.name) group by 1, 2) select query_id, edge_id, r rank from (select *, row_number() over (partition by query_id order by hit, w desc nulls last, edge_id) r from x)",
    "search_global": _N + "select query_id, kb_id, name, rank from gl",
    "search_hybrid": _N + ", u as (select query_id, kb_id || '/' || name item, min(rank) rank, 0 s from hn group by 1, 2 union all select query_id, kb_id || '/' || name, rank, 1 from gl), f as (select query_id, item, min(rank * 2 + s) o from u group by 1, 2) select query_id, item, row_number() over (partition by query_id order by o, item) position from f",
    "search_chunks": _N + "select query_id, chunk_id, n, rank from cw",
    "search_context": _N + ", x as (select query_id, cw.chunk_id, rank, length(content) l, coalesce(sum(length(content)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) used from cw join ch on ch.chunk_id = cw.chunk_id and not gone) select query_id, chunk_id, rank, least(l, 600 - used) n_chars from x where used < 600",
    "search_citations": _N + r", a as (select distinct pack_id, lower(unnest(regexp_extract_all(array_to_string(list_transform(evidence, lambda z: 'see ' || coalesce(z.chunk_id, '')), '; '), '(?i)\bchunk-[0-9a-f]{32}\b'))) k from (select distinct pack_id, evidence from evidencepack)) select pack_id answer_id, k chunk_id, coalesce(c.page_idx, -1) page_idx, length(c.content[1:320]) n_chars from a left join (select * from ch where not gone) c on c.chunk_id = a.k",
}
