"""Queries over results of parsers, batches and modes of retrieval, and the SQL they are checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spindle.engine import Config, Engine, KnowledgeBase
from spindle.functions.predicates import stripped
from spindle.operators import retrieval as R
from spindle.operators.evaluation import review_sheet
from spindle.operators.graph import keys_of, subgraph
from spindle.plans.evaluation_queries import samples
from spindle.plans.block_queries import W, blocks
from spindle.plans.graph_queries import _N, chunks, edges, nodes
from spindle.sources import files, parsers as S
from spindle.session import keep, shared_dir, table, written

TREE = '{"body": {"children": [{"$ref": "#/texts/0"}, {"$ref": "#/groups/0"}, {"$ref": "#/tables/0"}, {"$ref": "#/pictures/0"}]}, "groups": [{"children": [{"$ref": "#/texts/1"}]}], "texts": [{"label": "title", "orig": %s}, {"label": "formula", "orig": "x = 1"}], "tables": [{"data": [[1]], "caption": "t"}], "pictures": [{"caption": "p", "image": {"uri": "data:image/png;base64,AA=="}}]}'


def source_ocr(spark, d):
    """Lines of text as an OCR result would hold them, in pages."""
    b = blocks(spark, d, "block_id", "type", "text", "page_idx").filter((F.col("type") == "text") & F.col("text").isNotNull())
    lines = F.split("text", "\n")
    result = F.to_json(F.struct(F.transform(lines, lambda x: F.struct(F.lit(0.5).alias("score"), F.array(x).alias("rec_texts"))).alias("pages"), F.lit(1).alias("n")))
    return S.ocr_blocks(b.withColumn("result", result), "block_id", "result", "page_idx").select("block_id", "page_idx", "line_no", "text")


def source_trees(spark, d):
    """Document trees with the file's name as title, as blocks."""
    f = table(spark, d, "test4_content_list").select("file_path").filter(F.col("file_path").isNotNull()).distinct()
    name = F.regexp_replace(F.to_json(F.array("file_path")), r"^\[|\]$", "")
    head, tail = TREE.split("%s")
    t = f.select("file_path", F.posexplode(S.tree_blocks(F.concat(F.lit(head), name, F.lit(tail)))).alias("i", "b"))
    return t.select("file_path", "i", "b.type", "b.text", "b.img_path", "b.caption", "b.page_idx")


def source_html(spark, d):
    """Cells of tables in HTML."""
    b = blocks(spark, d, "block_id", "type", "table_body").filter(F.col("table_body").isNotNull())
    return b.select("block_id", F.posexplode(S.html_blocks(F.col("table_body"))).alias("i", "c")).select("block_id", "i", "c.tag", "c.text")


def source_markup(spark, d):
    """Texts with marks of Markdown, as markup."""
    b = blocks(spark, d, "block_id", "type", "text").filter((F.col("type") == "text") & F.length("text").between(6, 40) & ~F.col("text").rlike(r"[*_`\[\]~\n]"))
    head, rest = F.substring("text", 1, 3), F.expr("substring(text, 4)")
    t = F.concat(F.lit("**"), head, F.lit("** & *"), rest, F.lit("* `"), head, F.lit("` ["), head, F.lit("](u) ~~"), rest, F.lit("~~ a_b_c <x>"))
    return b.select("block_id", S.inline_markup(t).alias("markup"))


def source_markdown(spark, d):
    """Blocks of files made of the headings and lines of their texts."""
    b = blocks(spark, d, "block_id", "file_path", "block_idx", "type", "text", "text_level").filter((F.col("type") == "text") & F.col("text").isNotNull() & ~F.col("text").rlike(r"[\n\r#]"))
    text = F.concat(F.repeat(F.lit("#"), F.coalesce("text_level", F.lit(0))), F.when(F.coalesce("text_level", F.lit(0)) > 0, " ").otherwise(""), "text", F.lit("\n\n"))
    return S.markdown_blocks(b.select(F.col("block_id").cast("string").alias("file_path"), text.alias("text"))).select(F.col("file_path").cast("long").alias("block_id"), "block_idx", "text", "text_level")


def parsed(path: str) -> list[dict]:
    """A stand-in for a parser: fails for names of even length, finds nothing in those of length 3 mod 4."""
    if len(path) % 2 == 0:
        raise OSError("broken file")
    return [] if len(path) % 4 == 3 else [{"text": path}, {"type": "table", "page_idx": 1}]


def _batch(spark, d):
    f = table(spark, d, "test4_content_list").select(F.col("file_path").alias("path")).filter(F.col("path").isNotNull()).distinct()
    return S.parse_batch(f, parsed, [".PDF"])


def source_batch(spark, d):
    return S.batch_report(_batch(spark, d))


def source_batch_blocks(spark, d):
    return S.batch_blocks(_batch(spark, d)).select("file_path", "block_idx", "type", "text", "page_idx")


def source_to_parse(spark, d):
    f = table(spark, d, "image_files").select("file_path").filter(F.col("file_path").isNotNull()).distinct()
    done = table(spark, d, "test4_content_list").groupBy("file_path").agg(F.count(F.lit(1)).alias("n_blocks")).filter(F.length("file_path") % 2 == 0)
    return S.to_parse(f, done)


def source_registry(spark, d):
    """Folders of knowledge bases: those known, and those of files that hold a graph."""
    n = table(spark, d, "graphnode").filter(F.col("kb_id").isNotNull()).groupBy("kb_id").agg(F.min("created_at").alias("created_at"))
    known = n.filter(F.length("kb_id") % 2 == 0).select("kb_id", F.concat(F.lit("/kb/"), "kb_id").alias("working_dir"), "created_at")
    name = F.when(F.ascii(F.substring("kb_id", -1, 1)) % 3 == 0, "other.txt").otherwise("kv_store_text_chunks.json")
    listing = n.select(F.concat(F.lit("/kb/"), "kb_id", F.lit("/")).alias("working_dir"), name.alias("file_name"), F.col("created_at").alias("seen_at"))
    return files.knowledge_bases(listing, known).select("working_dir", "created_at")


def _folder(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    keep(path)
    return path


def _graphml(spark, d):
    """A graph written as GraphML and read again; numbers stand for names, as those aren't one to a file."""
    path = _folder(spark, "graphml")
    n = nodes(spark, d).select(F.col("node_id").cast("string").alias("id"), "entity_type", "description")
    e = edges(spark, d).select(F.concat_ws("/", "kb_id", "source").alias("source"), F.concat_ws("/", "kb_id", "target").alias("target"), F.col("edge_id").cast("string").alias("number"), F.col("relation_type").alias("keywords"), "weight")
    files.write_graphml(n, e, path, ["entity_type", "description"], ["number", "keywords", "weight"])
    return files.read_graphml(spark, path)


def source_graphml_nodes(spark, d):
    n = _graphml(spark, d)[0]
    told = lambda k: stripped(F.coalesce(F.try_element_at("attributes", F.lit(k)), F.lit("")))
    return n.select(F.col("id").cast("long").alias("node_id"), told("entity_type").alias("entity_type"), F.md5(told("description")).alias("said"))


def source_graphml_edges(spark, d):
    e = _graphml(spark, d)[1]
    return e.select(F.col("attributes")["number"].cast("long").alias("edge_id"), stripped(F.col("source")).alias("source"), stripped(F.col("target")).alias("target"), stripped(F.col("relation_type")).alias("relation_type"), F.col("attributes")["weight"].cast("double").alias("weight"))


def source_json_lines(spark, d):
    """Samples written as JSON lines and read again."""
    s = samples(spark, d, "question", "evidence", "quality")
    path = _folder(spark, "lines")
    files.write_json_lines(s, path)
    return files.read_json_lines(spark, path, s.schema).select("id", F.md5(F.coalesce("question", F.lit(""))).alias("question"), F.coalesce(F.size("evidence"), F.lit(-1)).cast("long").alias("n"), F.col("quality.judge_score").alias("judge_score"))


def source_sheet(spark, d):
    """The review sheet written and read again."""
    path = _folder(spark, "sheet")
    files.write_review_sheet(review_sheet(samples(spark, d, "task_type", "modality", "question", "gold_answer", "evidence", "quality", "metadata")), path)
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').csv(path)
    r = r.toDF(*[c.lstrip("\ufeff") for c in r.columns])
    return r.select("id", "status", F.coalesce("evidence_chunks", F.lit("")).alias("evidence_chunks"), "judge_score", F.coalesce("reasons", F.lit("")).alias("reasons"))


def source_store(spark, d):
    """The reference list written as a store of one object, and read again."""
    t = table(spark, d, "canonical_types")
    path = _folder(spark, "store")
    one = t.agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(F.col("canonical_id").cast("string").alias("k"), F.struct("kind", "name", "other_names").alias("v"))))).alias("value"))
    one.write.text(path)
    kind = T.StructType([t.schema["kind"], t.schema["name"], t.schema["other_names"]])
    return files.read_store(spark, path, kind).select(F.col("key").cast("int").alias("canonical_id"), "kind", "name", F.array_join("other_names", "|").alias("other_names"))


def _kb(spark: SparkSession, d: str) -> tuple[KnowledgeBase, DataFrame]:
    """Every third vector stands for a node, an edge or the first chunk of the node of its number."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding")
    n, g = nodes(spark, d), edges(spark, d)
    first = n.select(F.col("node_id").alias("vec_id"), F.get(keys_of("source_ids"), F.lit(0)).alias("key"))
    kind = F.element_at(F.array(F.lit("entity"), F.lit("relation"), F.lit("chunk")), (F.col("vec_id") % 3 + 1).cast("int"))
    v = e.join(first, "vec_id", "left").withColumn("kind", kind)
    v = v.withColumn("item", F.when(F.col("kind") == "chunk", F.col("key")).otherwise(F.col("vec_id").cast("string"))).filter(F.col("item").isNotNull()).select("vec_id", "kind", "item", "embedding")
    q = e.filter(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("query_id"), "embedding")
    c = chunks(spark, d).select("chunk_id", "content", "ingested_at")
    return KnowledgeBase(n, g, c, written(v, "vectors")), q


def _mode(spark, d, mode: str):
    kb, q = _kb(spark, d)
    return Engine(spark, Config(context_budget=400)).retrieve(kb, q, mode).select("query_id", "chunk_id", "rank", F.length("content").alias("n_chars"))


def search_mode_local(spark, d):
    return _mode(spark, d, "local")


def search_mode_global(spark, d):
    return _mode(spark, d, "global")


def search_mode_hybrid(spark, d):
    return _mode(spark, d, "hybrid")


def search_mode_mix(spark, d):
    return _mode(spark, d, "mix")


def search_mode_naive(spark, d):
    return _mode(spark, d, "naive")


def search_whole_context(spark, d):
    """Entities, relations and chunks of each query as one text."""
    kb, q = _kb(spark, d)
    c = Engine(spark, Config(context_budget=400)).context(kb, q.select("query_id", "embedding"), "naive")
    return c.select("query_id", F.md5("context").alias("context"))


def search_chunks_vector(spark, d):
    """The chunks of the entities found, nearest to the query first; a chunk has the vector of the first node that names it."""
    kb, q = _kb(spark, d)
    near = R.vector_top_k(q, kb.vectors.filter("kind = 'entity'").select("vec_id", "embedding"))
    hits = near.join(kb.nodes.select(F.col("node_id").alias("vec_id"), keys_of("source_ids").alias("source_ids")), "vec_id")
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("node_id"), "embedding")
    v = kb.nodes.select("node_id", F.explode(keys_of("source_ids")).alias("chunk_id")).join(e, "node_id").groupBy("chunk_id").agg(F.min_by("embedding", "node_id").alias("embedding"))
    return R.by_vector(hits, q, v, most=20).select("query_id", "chunk_id", F.round("score", 5).alias("score"), "rank")


def search_one(spark, d):
    """Retrieval and citations of one question over a knowledge base: what a user waits for, models aside."""
    kb, q = _kb(spark, d)
    c = Engine(spark, Config(context_budget=12_000)).retrieve(kb, q.filter(F.col("query_id") == 0), "mix")
    told = kb.chunks.select("chunk_id", F.substring("content", 1, 320).alias("snippet"))
    return c.select("query_id", "chunk_id", "rank").join(told, "chunk_id").select("query_id", "chunk_id", "rank", F.length("snippet").alias("n_chars"))


def search_focus(spark, d):
    """The part of a graph that the chunks of one question support."""
    one = search_one(spark, d).select("chunk_id")
    return subgraph(nodes(spark, d), edges(spark, d), written(one, "focus"))[0].select("kb_id", "node_id")


QUERIES = {f.__name__: f for f in (
    source_ocr, source_trees, source_html, source_markup, source_markdown, source_batch, source_batch_blocks, source_to_parse, source_registry, source_graphml_nodes, source_graphml_edges, source_json_lines, source_sheet, source_store,
    search_mode_local, search_mode_global, search_mode_hybrid, search_mode_mix, search_mode_naive, search_whole_context, search_chunks_vector, search_one, search_focus,
)}

_B = "with b as (select distinct block_id, file_path, block_idx, type, text, text_level, page_idx, table_body from test4_content_list)"
_STRIP = lambda c: f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"
_MODES = _N + """, vk as (select v.vec_id, embedding, ['entity', 'relation', 'chunk'][v.vec_id % 3 + 1] kind, f.k from embeddings v left join (select node_id, arg_min(k, (i, j)) k from nk group by 1) f on f.node_id = v.vec_id),
hk as (select query_id, vec_id, kind, k, row_number() over (partition by query_id, kind order by s desc, vec_id) rank from (select q.vec_id query_id, v.vec_id, v.kind, v.k, list_cosine_similarity(cast(q.embedding as double[]), cast(v.embedding as double[])) s from embeddings q, vk v where q.vec_id % 20 = 0 and (v.kind <> 'chunk' or v.k is not null)) where s >= 0.2),
h10 as (select * from hk where rank <= 10),
lo as (select query_id, k, row_number() over (partition by query_id order by n desc, best, k) rank from (select query_id, k, count(*) n, min(rank) best from (select distinct h.query_id, h.vec_id, h.rank, nk.k from h10 h join nk on nk.node_id = h.vec_id where h.kind = 'entity') group by 1, 2)),
go as (select query_id, k, row_number() over (partition by query_id order by n desc, best, k) rank from (select query_id, k, count(*) n, min(rank) best from (select distinct h.query_id, h.vec_id, h.rank, ek.k from h10 h join ek on ek.edge_id = h.vec_id where h.kind = 'relation') group by 1, 2)),
na as (select query_id, k, rank from h10 where kind = 'chunk')"""


def _merged(*lists: str) -> str:
    every = " union all ".join(f"select query_id, k, rank, {i} z from {n}" for i, n in enumerate(lists))
    return _MODES + f""", al as ({every}), fi as (select query_id, k, min((rank, z)) a from al group by 1, 2), po as (select query_id, k, row_number() over (partition by query_id order by a, k) rank from fi),
tx as (select query_id, po.k, rank, ch.content, coalesce(sum(length(ch.content)) over (partition by query_id order by rank rows between unbounded preceding and 1 preceding), 0) used from po join ch on ch.chunk_id = po.k and not ch.gone)"""


_SHOW = " select query_id, k chunk_id, rank, least(length(content), 400 - used)::int n_chars from tx where used < 400"
ORACLE_SQL = {
    "source_ocr": _B + f", l as (select block_id, page_idx, unnest(string_split(text, chr(10))) t, generate_subscripts(string_split(text, chr(10)), 1) i from b where type = 'text' and text is not null), s as (select block_id, page_idx, i, {_STRIP('t')} t from l) select block_id, page_idx, row_number() over (partition by block_id order by i) - 1 line_no, t as text from s where t <> ''",
    "source_trees": "with f as (select distinct file_path from test4_content_list where file_path is not null) select file_path, i, type, t as text, img img_path, cap caption, p page_idx from f, (values (0, 'text', null, null, null, 0), (1, 'equation', 'x = 1', null, null, 0), (2, 'table', null, null, 't', 0), (3, 'image', null, 'images/image_0.png', 'p', 0)) v(i, type, t0, img, cap, p), lateral (select case when i = 0 then file_path else t0 end t)",
    "source_html": _B + rf", c as (select block_id, unnest(regexp_extract_all(table_body, '(?is)<(?:td|th)\b[^>]*>.*?</(?:td|th)\s*>')) x, generate_subscripts(regexp_extract_all(table_body, '(?is)<(?:td|th)\b[^>]*>.*?</(?:td|th)\s*>'), 1) i from b where table_body is not null), d as (select block_id, i, lower(regexp_extract(x, '^<(\w+)', 1)) tag, trim(regexp_replace(regexp_replace(x, '<[^>]+>', '', 'g'), '{W}+', ' ', 'g')) t from c) select block_id, row_number() over (partition by block_id order by i) - 1 i, tag, replace(replace(replace(replace(replace(replace(t, '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', chr(39)), '&nbsp;', ' '), '&amp;', '&') as text from d where t <> ''",
    "source_markup": _B + r""", t as (select block_id, replace(replace(replace(text[1:3], '&', '&amp;'), '<', '&lt;'), '>', '&gt;') h, replace(replace(replace(substr(text, 4), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') r from b where type = 'text' and length(text) between 6 and 40 and not regexp_matches(text, '[*_`\[\]~\n]'))
      select block_id, '<b>' || h || '</b> &amp; <i>' || r || '</i> <font name="Courier" size="9" color="darkred">' || h || '</font> <link href="u" color="blue"><u>' || h || '</u></link> <strike>' || r || '</strike> a_b_c &lt;x&gt;' markup from t""",
    "source_markdown": _B + r" select block_id, 0 block_idx, trim(text) as text, case when coalesce(text_level, 0) > 0 then text_level end text_level from b where type = 'text' and text is not null and not regexp_matches(text, '[\n\r#]') and trim(text) <> ''",
    "source_batch": "with f as (select distinct file_path p from test4_content_list where file_path is not null and lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) = '.pdf') select count(*) n_files, count(*) filter (length(p) % 4 = 1) n_ok, count(*) filter (length(p) % 4 <> 1) n_failed, round(100.0 * count(*) filter (length(p) % 4 = 1) / count(*), 2)::double success_rate from f",
    "source_batch_blocks": "with f as (select distinct file_path p from test4_content_list where file_path is not null and length(file_path) % 4 = 1 and lower(regexp_extract(file_path, '(\\.[^./]+)$', 1)) = '.pdf') select p file_path, 0 block_idx, 'text' type, p as text, 0 page_idx from f union all select p, 1, 'table', null, 1 from f",
    "source_to_parse": "select distinct file_path from image_files where file_path is not null and file_path not in (select file_path from test4_content_list where file_path is not null and length(file_path) % 2 = 0)",
    "source_graphml_nodes": f"select node_id, {_STRIP("coalesce(any_value(entity_type), '')")} entity_type, md5({_STRIP("coalesce(any_value(description), '')")}) said from graphnode where id is not null group by 1",
    "source_graphml_edges": f"select edge_id, {_STRIP("concat_ws('/', any_value(kb_id), any_value(source))")} source, {_STRIP("concat_ws('/', any_value(kb_id), any_value(target))")} target, {_STRIP("coalesce(any_value(relation_type), '')")} relation_type, any_value(weight) weight from graphedge group by 1",
    "source_json_lines": "select id, md5(coalesce(any_value(question), '')) question, coalesce(len(any_value(evidence)), -1) n, any_value(quality).judge_score judge_score from rejected group by 1",
    "source_sheet": "select id, coalesce(q.status, '') status, array_to_string(list_transform(coalesce(e, []), lambda z: coalesce(z.chunk_id, '')), '|') evidence_chunks, coalesce(q.judge_score::varchar, '') judge_score, coalesce(array_to_string(q.reasons, '|'), '') reasons from (select id, any_value(quality) q, any_value(evidence) e from rejected group by 1)",
    "source_store": "select canonical_id, kind, name, array_to_string(other_names, '|') other_names from canonical_types",
    "source_registry": "with n as (select kb_id, min(created_at) created_at from graphnode where kb_id is not null group by 1) select '/kb/' || kb_id working_dir, created_at from n where length(kb_id) % 2 = 0 or ord(kb_id[-1]) % 3 <> 0",
    "search_mode_local": _merged("lo") + _SHOW,
    "search_mode_global": _merged("go") + _SHOW,
    "search_mode_hybrid": _merged("lo", "go") + _SHOW,
    "search_mode_mix": _merged("lo", "go", "na") + _SHOW,
    "search_mode_naive": _merged("na") + _SHOW,
    "search_chunks_vector": _MODES + """, cv as (select k, arg_min(embedding, node_id) v from nk join embeddings e on e.vec_id = nk.node_id group by 1), nm as (select distinct query_id, nk.k from h10 h join nk on nk.node_id = h.vec_id where h.kind = 'entity'),
      sc as (select query_id, nm.k, list_cosine_similarity(cast(q.embedding as double[]), cast(v as double[])) s from nm join cv using (k) join embeddings q on q.vec_id = nm.query_id)
      select query_id, k chunk_id, round(s, 5) score, r rank from (select *, row_number() over (partition by query_id order by s desc, k) r from sc) where r <= 20""",
    "search_one": _merged("lo", "go", "na").replace(" 400", " 12000") + " select query_id, k chunk_id, rank, least(length(content), 320)::int n_chars from tx where used < 12000 and query_id = 0",
    "search_focus": _merged("lo", "go", "na") + """, oc as (select distinct k from tx where used < 12000 and query_id = 0), oe as (select distinct e.* from e join ek using (edge_id) join oc using (k)),
      oh as (select distinct kb_id, id as name from n join nk using (node_id) join oc using (k) union select kb_id, source from oe union select kb_id, target from oe)
      select kb_id, node_id from (select n.kb_id, n.node_id, row_number() over (partition by n.kb_id order by n.node_id) r from n join oh on oh.kb_id = n.kb_id and oh.name = n.id) where r <= 180""",
    "search_whole_context": _merged("na") + ", qs as (select distinct vec_id query_id from embeddings where vec_id % 20 = 0), cx as (select query_id, string_agg('[' || k || '] ' || content[1:(400 - used)::bigint], chr(10) order by rank) t from tx where used < 400 group by 1) select qs.query_id, md5(coalesce('Chunks:' || chr(10) || t, '')) context from qs left join cx using (query_id)",
}
