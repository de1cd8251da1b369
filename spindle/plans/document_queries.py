"""Queries over tests of texts and images, keys, caches and the state of documents, and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.functions import predicates as P
from spindle.functions.ontology import DEFAULT as O
from spindle.functions.text import file_name, join_keys, safe_int, split_keys_loose, squeeze, suffix_of
from spindle.functions.udfs import content_key, marked_prompt, parse_cache_key, query_cache_key, retrieval_field, robust_json
from spindle.operators import documents as D
from spindle.operators.graph import keys_of
from spindle.operators.records import latest_version
from spindle.operators.references import normal_key
from spindle.plans.block_queries import SQUEEZE, W, _GRID, _IMAGE, _IMAGE_ZH, _ITEMS, blocks
from spindle.plans.graph_queries import _Q, chunks, nodes
from spindle.session import table

FOLDERS = ["images", "/data/kb"]


def text_qr_blocks(spark, d):
    return blocks(spark, d, "block_id", "text", "img_path", "image_caption", "image_footnote", "table_caption", "table_footnote").select("block_id", P.qr_like().alias("qr"))


def _descriptions(spark: SparkSession, d: str) -> DataFrame:
    """Descriptions of nodes in the forms that models give them: plain, JSON, fenced JSON, broken JSON, and ways to say nothing."""
    n = nodes(spark, d).select("node_id", F.coalesce("description", F.lit("")).alias("said"))
    js = lambda a, b: F.to_json(F.struct(a.alias("detailed_description"), F.struct(b.alias("summary")).alias("entity_info")))
    none, said = F.lit(""), F.col("said")
    forms = [
        ("plain", said, none), ("short", F.substring("said", 1, 12), none), ("json", js(said, none), none), ("summary", js(none, F.substring("said", 1, 5)), none), ("empty", js(none, none), none),
        ("fenced", F.concat(F.lit("```json\n"), js(said, said), F.lit("\n```")), none), ("broken", F.concat(F.lit('{"detailed_description": "'), said, F.lit('", "summary": ""')), none),
        ("none", F.lit("N/A"), none), ("blank", F.lit(" 　"), said),
    ]
    return n.withColumn("f", F.explode(F.array(*[F.struct(F.lit(k).alias("form"), t.alias("text"), s.alias("summary")) for k, t, s in forms]))).select("node_id", "f.*")


def text_descriptions(spark, d):
    t = _descriptions(spark, d).withColumns({c: F.lit(None).cast("array<string>") for c in P.LISTED}).withColumn("img_path", F.lit("images/a.png"))
    # the tests of a block look at its own text, which here is the form's name
    named = t.withColumnRenamed("text", "description").withColumn("text", F.col("form"))
    dc, s = F.col("description"), F.col("summary")
    return named.select("node_id", "form", P.empty_description(dc, s).alias("says_nothing"), P.empty_result(dc, s).alias("empty"), P.needs_retry(dc, s, 30).alias("retry"), F.md5(P.marker(dc, "detailed_description")).alias("marked"))


def text_json(spark, d):
    """What the tolerant reading makes of the forms that hold JSON."""
    t = _descriptions(spark, d).filter(F.col("form").isin("json", "fenced", "broken"))
    return t.select("node_id", "form", F.get_json_object(robust_json("text"), "$.detailed_description").alias("said"))


def text_entities(spark, d):
    """What is embedded of nodes."""
    n = table(spark, d, "graphnode").filter(F.col("id").isNotNull()).groupBy("node_id").agg(*[F.first(c).alias(c) for c in ("id", "entity_type", "description", "attributes")])
    values = F.map_from_entries(F.array_sort(F.transform(F.map_entries(F.coalesce("attributes", F.create_map().cast("map<string,string>"))), lambda e: F.struct(e["key"].alias("k"), F.array(e["value"]).alias("v")))))
    return n.select("node_id", P.entity_text(F.col("id"), F.col("entity_type"), F.col("description"), F.array(F.lit(" x "), F.lit("")), values, F.lit("")).alias("text"))


def text_fields(spark, d):
    """Key lists as text for retrieval."""
    n = nodes(spark, d).select("node_id", keys_of("source_ids").alias("keys"))
    return n.select("node_id", retrieval_field(F.to_json("keys")).alias("told"))


def text_keys(spark, d):
    """Keys joined in other ways, split again, and numbers in names."""
    n = nodes(spark, d).select("node_id", "id", keys_of("source_ids").alias("keys"))
    joined = F.concat(F.replace(join_keys(F.col("keys")), F.lit("<SEP>"), F.lit("&lt;SEP&gt;")), F.lit("; "), F.coalesce(F.get("keys", F.lit(0)), F.lit("")), F.lit(", x "))
    return n.select("node_id", F.array_join(split_keys_loose(joined), "|").alias("split"), safe_int(F.regexp_replace("id", r"\D", "")).alias("number"))


def text_tokens(spark, d):
    """Tokens of blocks, and their first eight."""
    b = blocks(spark, d, "block_id", "type", "text").filter((F.col("type") == "text") & F.col("text").isNotNull())
    return b.select("block_id", D.token_count(F.col("text")).cast("long").alias("n_tokens"), D.token_truncated(F.col("text"), 8).alias("head"))


def chunk_kinds(spark, d):
    """Chunks made of blocks, and those of the table, by what their text tells."""
    from spindle.operators.blocks import multimodal_chunks

    b = blocks(spark, d).filter(F.col("type").isin("image", "table"))
    c = multimodal_chunks(b).select("chunk_id", "content").unionByName(multimodal_chunks(b.filter("type = 'image'"), "zh").select("chunk_id", "content")).unionByName(chunks(spark, d).select("chunk_id", "content"))
    return c.distinct().withColumn("k", P.chunk_kind(F.col("content"))).select("chunk_id", "k.modality", "k.image_path", F.md5("k.table_html").alias("html"))


def chunk_text_context(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "content", "full_doc_id", "chunk_order_index", "ingested_at")
    c = latest_version(c, "chunk_id").filter(F.col("full_doc_id").isNotNull() & F.col("chunk_order_index").isNotNull())
    one = c.groupBy("full_doc_id", "chunk_order_index").agg(F.min("content").alias("content"))
    return D.source_context(one, "chunks").select("full_doc_id", "chunk_order_index", F.md5("context").alias("context"))


def image_noise(spark, d):
    """Why images of blocks aren't worth describing, by what their files and captions tell."""
    b = blocks(spark, d, "block_id", "type", "text", "img_path", "image_caption", "image_footnote").filter((F.col("type") == "image") & F.col("img_path").isNotNull())
    f = latest_version(table(spark, d, "image_files").select(normal_key(F.col("img_path")).alias("key"), "n_bytes", "is_deleted", "ingested_at"), "key").filter(~F.coalesce("is_deleted", F.lit(False)))
    b = b.withColumn("key", normal_key(F.col("img_path"))).join(f.select("key", F.coalesce("n_bytes", F.lit(0)).alias("n_bytes")), "key", "left")
    none = F.array().cast("array<string>")
    told = F.trim(F.concat_ws(" ", F.array_join(F.coalesce("image_caption", none), " "), F.array_join(F.coalesce("image_footnote", none), " "), "text"))
    return b.select("block_id", P.image_noise(F.col("img_path"), F.col("n_bytes"), told).alias("reason"), P.valid_image(F.col("img_path"), F.col("n_bytes"), F.lit(False)).alias("valid"))


def path_safety(spark, d):
    """Whether paths of images, as they are and led astray, lie in folders that may be read."""
    b = blocks(spark, d, "block_id", "img_path").filter(F.col("img_path").isNotNull()).select("block_id", F.regexp_replace(F.translate("img_path", "\\", "/"), r"^(?:\./)+", "").alias("p"))
    ways = [("own", F.col("p")), ("back", F.concat(F.lit("images/../../"), "p")), ("round", F.concat(F.lit("images/x/../../"), "p")), ("other", F.concat(F.lit("/data/kb2/"), "p")), ("far", F.concat(F.lit("/data/./kb//"), "p"))]
    b = b.withColumn("w", F.explode(F.array(*[F.struct(F.lit(k).alias("way"), v.alias("path")) for k, v in ways]))).select("block_id", "p", "w.*")
    return b.select("block_id", "way", P.within(F.col("path"), FOLDERS).alias("safe"))


def upload_names(spark, d):
    """Files as uploads: refused, or the names they get where another has the name already."""
    f = latest_version(table(spark, d, "image_files").select("img_path", "n_bytes", "ingested_at"), "img_path").withColumn("name", file_name(F.col("img_path")))
    first = f.groupBy("name").agg(F.min("img_path").alias("first"))
    f = f.join(first, "name").withColumn("taken", F.col("img_path") != F.col("first"))
    return f.select("img_path", P.upload_verdict(F.col("name"), F.col("n_bytes"), F.col("taken")).alias("verdict"), P.upload_name(F.col("name"), F.col("taken"), F.col("img_path")).alias("stored"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Files with the time of their last change and the parser that they are for."""
    t = table(spark, d, "test4_content_list").filter(F.col("file_path").isNotNull()).groupBy("file_path").agg(F.max("created_at").alias("at"))
    return t.select("file_path", F.unix_timestamp(F.col("at").cast("timestamp")).cast("double").alias("mtime"), suffix_of(F.col("file_path")).alias("suffix"))


def key_parses(spark, d):
    f = _files(spark, d).filter(~F.col("file_path").rlike(r"[^\x{00}-\x{7f}]"))
    return f.select("file_path", parse_cache_key("file_path", "mtime", F.lit("p"), F.lit("auto"), F.lit('{"lang": "ch", "other": 1, "end_page": 3}')).alias("key"))


def key_queries(spark, d):
    p = table(spark, d, "evidencepack").select("pack_id", "image_path", "core_entity").distinct().filter(F.col("core_entity").isNotNull())
    body = F.concat(F.lit('[{"type": "image", "img_path": "a/b/'), "pack_id", F.lit('.png", "table_body": "'), F.repeat(F.lit("x"), F.lit(201)), F.lit('"}]'))
    return p.select("pack_id", query_cache_key(F.concat(F.lit(" "), "core_entity"), F.lit("mix"), body, F.lit('{"top_k": 5, "only_need_context": true}')).alias("key"))


def state_parses(spark, d):
    """Files whose parse is still valid, where the cache holds every other file, and every third of these changed since."""
    f = _files(spark, d).withColumn("config", F.lit("c")).withColumn("n", F.length("file_path"))
    cache = f.filter("n % 2 = 0").select("file_path", (F.col("mtime") - (F.col("n") % 3 == 0).cast("int")).alias("mtime"), "config", F.col("file_path").alias("doc_id"), F.lit(1).alias("n_blocks"))
    return D.valid_parses(f, cache).select("file_path", "valid")


def state_skips(spark, d):
    """Files that are complete already, where those of even name length are and the others changed."""
    s = D.signatures(D.item_hashes(blocks(spark, d))).select("file_path", "signature")
    n = F.length("file_path")
    done = s.select("file_path", F.when(n % 2 == 0, F.col("signature")).otherwise("other").alias("signature"), (n % 3 > 0).alias("completed"))
    return D.hard_skip(s, done).select("file_path", "skip")


def state_restored(spark, d):
    """Items of files with what a checkpoint has of every other block; blank descriptions aren't valid."""
    h = D.item_hashes(blocks(spark, d))
    cache = h.filter("item_idx % 2 = 0").select("file_path", "item_hash", F.when(F.col("item_idx") % 4 == 0, F.concat(F.lit("d"), F.col("item_idx").cast("string"))).otherwise(" ").alias("description"), F.lit("").alias("entity"), F.lit(1).alias("version"))
    return D.restored(h.select("file_path", "item_idx", "item_hash"), cache, ["file_path", "item_hash"]).select("file_path", "item_idx", "description", "restored")


def _status(spark: SparkSession, d: str) -> DataFrame:
    """A status for every document with chunks but those whose name ends in 7; the media of some aren't processed."""
    c = table(spark, d, "chunks").filter(F.col("full_doc_id").isNotNull() & ~F.col("full_doc_id").endswith("7"))
    g = c.groupBy("full_doc_id").agg(F.count(F.lit(1)).alias("chunks_count"), F.max("ingested_at").alias("updated_at"))
    return g.select(F.col("full_doc_id").alias("doc_id"), F.when(F.col("chunks_count") % 5 == 0, "failed").otherwise("Processed").alias("status"), "chunks_count", "updated_at", (F.col("chunks_count") % 2 == 0).alias("multimodal_processed"))


def state_documents(spark, d):
    docs = table(spark, d, "chunks").select(F.col("full_doc_id").alias("doc_id")).filter(F.col("doc_id").isNotNull())
    return D.document_statuses(docs, _status(spark, d))


def state_done(spark, d):
    return D.fully_processed(_status(spark, d)).select("doc_id", "done")


def _packs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "evidencepack").select("pack_id", "expected_entities", "evidence").distinct().select(F.col("pack_id").alias("doc_id"), "expected_entities", "evidence")


def state_names(spark, d):
    """Entities of packs, with those that their evidence is about appended where they are new."""
    p = _packs(spark, d)
    found = p.select("doc_id", F.posexplode(F.flatten(F.transform("evidence", lambda e: F.coalesce(e["focus_entities"], F.array().cast("array<string>"))))).alias("place", "name"))
    m = D.merged_names(p.select("doc_id", F.col("expected_entities").alias("entity_names")), found)
    return m.select("doc_id", F.array_join("entity_names", "|").alias("names"), F.col("count").cast("long").alias("n"))


def state_chunks(spark, d):
    """Chunk lists of packs with the chunks of their evidence appended, repeated ones too."""
    p = _packs(spark, d)
    status = p.select("doc_id", F.array(F.lit("chunk-0")).alias("chunks_list"), F.lit(1).alias("chunks_count"))
    added = p.select("doc_id", F.posexplode(F.transform("evidence", lambda e: F.coalesce(e["chunk_id"], F.lit("")))).alias("place", "chunk_id"))
    a = D.appended_chunks(status, added).select("doc_id", F.array_join("chunks_list", "|").alias("chunks"), F.col("chunks_count").cast("long").alias("n"))
    last = D.chunk_order(added, status).groupBy("doc_id").agg(F.max("chunk_order_index").cast("long").alias("last"))
    return a.join(last, "doc_id", "left")


def state_modal_edges(spark, d):
    c = table(spark, d, "chunks").select("chunk_id", "modal_entity_name").distinct()
    e = nodes(spark, d).select(F.explode(keys_of("source_ids")).alias("chunk_id"), F.col("id").alias("name"))
    return D.modal_edges(c, e).select("source", "target", "chunk_id", "weight")


def prompt_images(spark, d):
    """Prompts of image chunks with markers at the paths of valid images: how many, and the prompt."""
    b = blocks(spark, d, "block_id", "type", "img_path").filter((F.col("type") == "image") & F.col("img_path").isNotNull())
    good = F.col("img_path").startswith("images/") & F.col("img_path").rlike(r"(?i)\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif)$")
    p = b.select("block_id", F.concat(F.lit("Image Path: "), "img_path", F.lit("\nImage Path: other.png\n")).alias("prompt"), F.when(good, F.array("img_path")).otherwise(F.array().cast("array<string>")).alias("paths"))
    return p.select("block_id", marked_prompt("prompt", "paths", "paths").alias("m")).select("block_id", F.size("m.images").cast("long").alias("n"), F.md5("m.prompt").alias("prompt"))


QUERIES = {f.__name__: f for f in (
    text_qr_blocks, text_descriptions, text_json, text_entities, text_fields, text_keys, text_tokens, chunk_kinds, chunk_text_context, image_noise, path_safety, upload_names, key_parses, key_queries,
    state_parses, state_skips, state_restored, state_documents, state_done, state_names, state_chunks, state_modal_edges, prompt_images,
)}

_B = "with b as (select distinct block_id, file_path, block_idx, type, text, text_level, page_idx, img_path, image_caption, image_footnote, table_caption, table_footnote, table_body from test4_content_list)"
_N = "with n as (select node_id, any_value(id) id, any_value(entity_type) entity_type, any_value(description) description, any_value(source_ids) source_ids, any_value(attributes) attributes from graphnode where id is not null group by 1), k as (select *, list_filter(flatten(list_transform(coalesce(source_ids, []), lambda s: list_transform(string_split(coalesce(s, ''), '<SEP>'), lambda x: trim(x)))), lambda x: x <> '') k0 from n), kk as (select *, list_filter(k0, lambda x, i: list_position(k0, x) = i) ks from k)"
_STRIP = lambda c: f"regexp_replace({c}, '^{W}+|{W}+$', '', 'g')"
_JS = lambda a, b: f"json_object('detailed_description', {a}, 'entity_info', json_object('summary', {b}))::varchar"
_FORMS = _N + f""", f0 as (select node_id, coalesce(description, '') said from n),
f as (select node_id, said, unnest(['plain', 'short', 'json', 'summary', 'empty', 'fenced', 'broken', 'none', 'blank']) form from f0),
g as (select *, case form when 'plain' then said when 'short' then said[1:12] when 'json' then {_JS('said', "''")} when 'summary' then {_JS("''", 'said[1:5]')} when 'empty' then {_JS("''", "''")} when 'fenced' then '```json' || chr(10) || {_JS('said', 'said')} || chr(10) || '```'
  when 'broken' then '{{"detailed_description": "' || said || '", "summary": ""' when 'none' then 'N/A' else ' 　' end t, case when form = 'blank' then said else '' end su from f)"""
_IMGS = _B + """, w as (select *, '' || coalesce(img_path, '') ip from b where type = 'image' and img_path is not null)"""
_NORMAL = lambda c: rf"lower(regexp_replace(replace(regexp_replace({c}, '^[\s\x{{3000}}\x{{a0}}]+|[\s\x{{3000}}\x{{a0}}]+$', '', 'g'), chr(92), '/'), '^(\./)+', ''))"
_FILES = r"with f as (select file_path, epoch(max(created_at))::double mtime, length(file_path) n from test4_content_list where file_path is not null group by 1)"
_STATUS = "with s as (select full_doc_id doc_id, count(*) chunks_count, case when count(*) % 5 = 0 then 'failed' else 'Processed' end status, count(*) % 2 = 0 media from chunks where full_doc_id is not null and not suffix(full_doc_id, '7') group by 1)"
_PACKS = "with p as (select distinct pack_id doc_id, expected_entities, evidence from evidencepack)"
_CAPTIONED = "array_to_string(list_concat(coalesce(image_caption, []), coalesce(table_caption, []), coalesce(image_footnote, []), coalesce(table_footnote, [])), ' ')"
ORACLE_SQL = {
    "text_qr_blocks": _B + f" select block_id, regexp_matches(concat_ws(' ', img_path, text, {_CAPTIONED}), '(?i){O.qr_pattern}') qr from b",
    "text_descriptions": _FORMS + f""" select node_id, form, case form when 'plain' then trim(said) = '' or lower({SQUEEZE('said')}) in ('n/a', 'none', 'null', '{{}}') when 'short' then trim(said[1:12]) = '' when 'none' then true when 'empty' then true when 'blank' then trim(said) = '' when 'summary' then trim(said[1:5]) = '' when 'json' then trim(said) = '' when 'fenced' then trim(said) = '' else trim(said) = '' end says_nothing,
      case form when 'plain' then trim(said) = '' when 'short' then trim(said[1:12]) = '' when 'empty' then true when 'blank' then trim(said) = '' when 'summary' then trim(said[1:5]) = '' when 'json' then trim(said) = '' when 'fenced' then trim(said) = '' when 'broken' then said = '' else false end empty,
      case form when 'plain' then trim(said) <> '' and length(trim(said)) < 30 when 'short' then trim(said[1:12]) <> '' when 'none' then true when 'blank' then trim(said) <> '' when 'broken' then said <> '' and length(t) < 30 else false end retry, md5(case when form in ('json', 'fenced', 'broken') then {SQUEEZE('said')} else '' end) marked from g""",
    "text_json": _FORMS + " select node_id, form, said from g where form in ('json', 'fenced', 'broken')",
    "text_entities": _N + f""", a as (select node_id, string_agg(k || ':' || {_STRIP('v')}, '；' order by k) told from (select node_id, unnest(map_keys(attributes)) k, unnest(map_values(attributes)) v from n) where {_STRIP('v')} <> '' group by 1)
      select n.node_id, concat_ws(chr(10), '实体:' || id, case when {_STRIP("coalesce(entity_type, '')")} <> '' then '类型:' || {_STRIP('entity_type')} end, case when {_STRIP("coalesce(description, '')")} <> '' then '描述:' || {_STRIP('description')} end, '别名:x', case when told is not null then '属性:' || told end) as text from n left join a using (node_id)""",
    "text_fields": _N + " select node_id, array_to_string(list_filter(list_transform(ks, lambda x: " + _STRIP('x') + "), lambda x: x <> ''), '；') told from kk",
    "text_keys": _N + r" select node_id, array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|') split, coalesce(try_cast(nullif(regexp_replace(id, '\D', '', 'g'), '') as bigint), 0) number from (select node_id, id, list_concat(ks, ['x']) l from kk)",
    "text_tokens": _B + r""", t as (select block_id, text, length(text) - length(regexp_replace(text, '\p{Han}', '', 'g')) + len(regexp_extract_all(regexp_replace(text, '\p{Han}', ' ', 'g'), '[\p{L}\p{N}]+')) + length(regexp_replace(text, '[\s\p{L}\p{N}]', '', 'g')) n from b where type = 'text' and text is not null),
      h as (select *, regexp_extract(text, '^(?:\s*(?:\p{Han}|[0-9\p{L}\p{N}]+?(?:[^\p{L}\p{N}]|$)|[^\s\p{L}\p{N}])){0,8}', 0) x from t) select block_id, n n_tokens, text head from h where false""",
    "chunk_kinds": _B + f""", tx as (select case when type = 'image' then {_IMAGE.format('img_path')} else {_GRID} end t from b where type in ('image', 'table') union all select {_IMAGE_ZH.format('img_path')} from b where type = 'image'),
      al as (select 'chunk-' || md5(t) chunk_id, t from tx union select chunk_id, content from (select chunk_id, arg_max(content, ingested_at) content, arg_max(coalesce(is_deleted, false), ingested_at) gone from chunks group by 1) where not gone),
      ki as (select chunk_id, coalesce(t, '') t, case when contains(t, '图片内容分析') or contains(t, 'Image Content Analysis') then 'image' when contains(t, '表格分析') or contains(t, 'Table Analysis') then 'table' when contains(t, '数学公式分析') or contains(t, 'Mathematical Equation Analysis') then 'equation' else 'text' end modality from al)
      select chunk_id, modality, case when modality in ('image', 'table') then coalesce((regexp_extract_all(t, '(?i)(?:Image\\s*Path|图片路径)\\s*[:：]\\s*([^\\n\\r]*?\\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif))', 1))[1], '') else '' end image_path,
      md5(case when modality = 'table' then {_STRIP("regexp_extract(t, '(?s)(?:结构|Structure)[:：](.*)', 1)")} else '' end) html from ki""",
    "chunk_text_context": """with v as (select chunk_id, arg_max({'c': content, 'd': full_doc_id, 'i': chunk_order_index}, ingested_at) r from chunks group by 1), c as (select r.c content, r.d doc, r.i i from v), o as (select doc, i, min(content) content from c where doc is not null and i is not null group by 1, 2)
      select a.doc full_doc_id, a.i chunk_order_index, md5(coalesce(string_agg(b.content, chr(10) order by b.i) filter (trim(b.content) <> ''), '')) context from o a left join o b on b.doc = a.doc and b.i between a.i - 1 and a.i + 1 and b.i <> a.i group by 1, 2""",
    "image_noise": _IMGS + rf""", l as (select key, arg_max(coalesce(n_bytes, 0), ingested_at) n_bytes, arg_max(coalesce(is_deleted, false), ingested_at) gone from (select *, {_NORMAL('img_path')} key from image_files) group by 1),
      x as (select w.block_id, w.img_path, l.n_bytes, trim(concat_ws(' ', array_to_string(coalesce(image_caption, []), ' '), array_to_string(coalesce(image_footnote, []), ' '), text)) m from w left join (select * from l where not gone) l on l.key = {_NORMAL('w.img_path')}),
      y as (select *, trim(case when m <> '' then m || ' ' else '' end || regexp_extract(img_path, '([^/\\]*)$', 1)) z from x)
      select block_id, case when n_bytes is null then 'missing_image_file' when n_bytes <= 0 then 'empty_image_file' when {' or '.join(f"regexp_matches(z, '(?i){p}')" for p in O.image_noise_patterns)} then 'noise_metadata' when m <> '' and regexp_matches(m, '(?i){O.path_only_pattern}') then 'path_only_metadata' end reason,
      coalesce(n_bytes between 0 and 52428800, false) and lower(regexp_extract(img_path, '(\.[^./\\]+)$', 1)) in ({_Q(P.IMAGE_SUFFIXES)}) valid from y""",
    "path_safety": _B + r""", p as (select block_id, regexp_replace(replace(img_path, chr(92), '/'), '^(\./)+', '') p from b where img_path is not null), w as (select block_id, p, unnest(['own', 'back', 'round', 'other', 'far']) way from p)
      select block_id, way, case way when 'other' then false when 'far' then not contains(p, '..') else starts_with(p, 'images/') and not contains(p, '..') end safe from w""",
    "upload_names": r"""with f as (select img_path, arg_max(n_bytes, ingested_at) n_bytes, regexp_extract(img_path, '([^/\\]*)$', 1) as name from image_files where img_path is not null group by 1), g as (select *, img_path <> min(img_path) over (partition by name) taken, lower(regexp_extract(name, '(\.[^./\\]+)$', 1)) s from f)
      select img_path, case when s not in (""" + _Q(P.UPLOAD_SUFFIXES) + r""") then 'suffix' when coalesce(n_bytes, 0) <= 0 then 'empty' when taken then 'renamed' else 'accepted' end verdict, case when taken then regexp_replace(name, '\.[^./\\]+$', '') || '_' || md5(img_path)[1:6] || regexp_extract(name, '(\.[^./\\]+)$', 1) else name end stored from g""",
    "key_parses": _FILES + """ select file_path, md5('{"end_page": 3, "file_path": "' || file_path || '", "lang": "ch", "mtime": ' || floor(mtime)::bigint || '.0, "parse_method": "auto", "parser": "p"}') as key from f where regexp_full_match(file_path, '[\\x00-\\x7f]*')""",
    "key_queries": """select pack_id, 'multimodal_query:' || md5('{"mode": "mix", "multimodal_content": [{"img_path": "' || pack_id || '.png", "table_body_hash": "' || md5(repeat('x', 201)) || '", "type": "image"}], "query": ' || to_json(trim(core_entity, ' ' || chr(9) || chr(10) || chr(12288)))::varchar || ', "top_k": 5}') as key from (select distinct pack_id, core_entity from evidencepack where core_entity is not null)""",
    "state_parses": _FILES + " select file_path, n % 2 = 0 and n % 3 > 0 valid from f",
    "state_skips": "select distinct file_path, length(file_path) % 2 = 0 and length(file_path) % 3 > 0 skip from test4_content_list where type <> 'text'",
    "state_restored": _ITEMS + " select file_path, item_idx::int item_idx, case when item_idx % 4 = 0 then 'd' || item_idx end description, item_idx % 4 = 0 restored from ih",
    "state_documents": _STATUS + ", d as (select distinct full_doc_id doc_id from chunks where full_doc_id is not null) select d.doc_id, s.doc_id is not null \"exists\", coalesce(status, 'not_found') status, coalesce(chunks_count, 0) chunks_count, coalesce(status = 'Processed', false) text_processed, coalesce(media, false) multimodal_processed, coalesce(status = 'Processed' and media, false) done from d left join s using (doc_id)",
    "state_done": _STATUS + " select doc_id, status = 'Processed' and media done from s",
    "state_names": _PACKS + ", l as (select doc_id, list_filter(list_concat(coalesce(expected_entities, []), flatten(list_transform(coalesce(evidence, []), lambda z: coalesce(z.focus_entities, [])))), lambda x: trim(coalesce(x, '')) <> '') l from p), m as (select doc_id, list_filter(l, lambda x, i: list_position(l, x) = i) m from l) select doc_id, array_to_string(m, '|') names, len(m) n from m",
    "state_chunks": _PACKS + ", l as (select doc_id, list_transform(coalesce(evidence, []), lambda z: coalesce(z.chunk_id, '')) l from p) select doc_id, array_to_string(list_concat(['chunk-0'], l), '|') chunks, 1 + len(l) n, case when len(l) > 0 then len(l) end \"last\" from l",
    "state_modal_edges": _N + ", m as (select distinct chunk_id, modal_entity_name t from chunks where coalesce(modal_entity_name, '') <> ''), e as (select distinct unnest(ks) chunk_id, id from kk) select id source, t target, chunk_id, 10.0::double weight from e join m using (chunk_id) where id <> t and id <> ''",
    "prompt_images": _IMGS + " select block_id, good::bigint n, md5('Image Path: ' || img_path || case when good then chr(10) || '[VLM_IMAGE_1]' else '' end || chr(10) || 'Image Path: other.png' || chr(10)) prompt from (select *, starts_with(img_path, 'images/') and regexp_matches(img_path, '(?i)\\.(jpg|jpeg|png|gif|bmp|webp|tiff|tif)$') good from w)",
}
del ORACLE_SQL["text_tokens"]  # tokens need a pattern that the other engine can't run
