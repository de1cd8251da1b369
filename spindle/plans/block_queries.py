"""Queries over content blocks and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.functions.text import file_name, has_ascii_word, has_cjk, image_paths, suffix_of, truncated
from spindle.operators import blocks as B, documents as D
from spindle.operators.records import first_version
from spindle.session import table

COLUMNS = ["block_id", "file_path", "block_idx", "type", "text", "text_level", "page_idx", "img_path", "image_caption", "image_footnote", "table_caption", "table_footnote", "table_body", "ingested_at"]


def blocks(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return first_version(table(spark, sf_dir, "test4_content_list").select(*(columns and [*columns, "ingested_at"] or COLUMNS)), "block_id")


def block_filter_report(spark, d):
    return B.filter_report(blocks(spark, d))


def block_filtered(spark, d):
    return B.filter_blocks(blocks(spark, d)).select("block_id", "type")


def block_separation(spark, d):
    s = B.separate(blocks(spark, d, "block_id", "file_path", "block_idx", "type", "text"))
    return s.select("file_path", F.length("text").alias("n_chars"), F.md5("text").alias("digest"), "n_multimodal")


def block_types(spark, d):
    return blocks(spark, d, "block_id", "file_path", "type").groupBy("file_path", "type").agg(F.count(F.lit(1)).alias("n"))


def block_page_context(spark, d):
    c = B.page_context(blocks(spark, d, "block_id", "file_path", "block_idx", "type", "text", "text_level", "page_idx", "image_caption", "table_caption"))
    return c.select("file_path", "page_idx", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


def block_chunk_context(spark, d):
    c = B.chunk_context(blocks(spark, d, "block_id", "file_path", "block_idx", "type", "text", "text_level", "image_caption", "table_caption"), 2)
    return c.select("file_path", "block_idx", F.md5("context").alias("digest"))


def block_text_truncated(spark, d):
    b = blocks(spark, d, "block_id", "type", "text").filter((F.col("type") == "text") & F.col("text").isNotNull())
    return b.select("block_id", truncated(F.col("text"), 60).alias("head"))


def block_chunks(spark, d):
    return B.multimodal_chunks(blocks(spark, d)).select("chunk_id", "file_path", "block_idx", "page_idx", "original_type")


def block_chunks_zh(spark, d):
    """Chunks by the Chinese templates, with the first caption as description."""
    b = blocks(spark, d).filter(F.col("type").isin("image", "header"))
    c = B.multimodal_chunks(b, "zh", F.coalesce(F.get("image_caption", F.lit(0)), F.lit("")))
    return c.select("chunk_id", "file_path", "block_idx", F.length("content").alias("n_chars"))


def block_document_ids(spark, d):
    return B.document_ids(blocks(spark, d))


def block_item_hashes(spark, d):
    return D.item_hashes(blocks(spark, d))


def block_signatures(spark, d):
    return D.signatures(D.item_hashes(blocks(spark, d)))


def block_paths(spark, d):
    """Image files by directory and suffix, as blocks name them."""
    p = blocks(spark, d, "block_id", "img_path").filter(F.col("img_path").isNotNull())
    return p.select("block_id", file_name(F.col("img_path")).alias("file_name"), suffix_of(F.col("img_path")).alias("suffix"), F.lower("img_path").rlike("qr|二维码").alias("qr"))


def block_scripts(spark, d):
    b = blocks(spark, d, "block_id", "file_path", "text").filter(F.col("text").isNotNull())
    return b.groupBy("file_path").agg(F.count_if(has_cjk(F.col("text"))).alias("n_cjk"), F.count_if(has_ascii_word(F.col("text"))).alias("n_ascii"), F.sum(F.length("text")).alias("n_chars"))


def chunk_image_paths(spark, d):
    """Image paths in chunks made of blocks, in either language, with a blank in their names."""
    b = blocks(spark, d).filter(F.col("type") == "image").withColumn("img_path", F.regexp_replace("img_path", r"^(.{3})", "$1 "))
    c = B.multimodal_chunks(b).unionByName(B.multimodal_chunks(b, "zh"))
    return c.select("chunk_id", F.explode(image_paths(F.col("content"))).alias("img_path")).distinct()


QUERIES = {f.__name__: f for f in (
    block_filter_report, block_filtered, block_separation, block_types, block_page_context, block_chunk_context, block_text_truncated, block_chunks,
    block_chunks_zh, block_document_ids, block_item_hashes, block_signatures, block_paths, block_scripts, chunk_image_paths,
)}

W = r"[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SQUEEZE = lambda c: f"trim(regexp_replace(coalesce({c}, ''), '{W}+', ' ', 'g'))"
_B = "with b as (select distinct block_id, file_path, block_idx, type, text, text_level, page_idx, img_path, image_caption, image_footnote, table_caption, table_footnote, table_body from test4_content_list)"
_T = "array_to_string(coalesce({0}, []), ', ')"
_REASON = _B + rf""", t as (
  select block_id, 0 n, 0 m, text x from b where text is not null
  union all select block_id, 1, generate_subscripts(image_caption, 1), unnest(image_caption) from b
  union all select block_id, 2, generate_subscripts(table_caption, 1), unnest(table_caption) from b
  union all select block_id, 3, generate_subscripts(image_footnote, 1), unnest(image_footnote) from b
  union all select block_id, 4, generate_subscripts(table_footnote, 1), unnest(table_footnote) from b
  union all select block_id, 5, 0, img_path from b where type = 'text' and img_path is not null
  union all select block_id, 6, 0, 'QR码' from b where regexp_matches(lower(coalesce(img_path, '')), 'qr|二维码')),
s as (select block_id, n, m, {SQUEEZE('x')} x from t),
h as (select block_id, n, m, case when x = '' then null when regexp_matches(x, '(?i)^\s*None\s*$') then 'none' when regexp_matches(x, '^\s*\d+\s*$') then 'number'
  when regexp_matches(x, '^\s*第?\s*\d+\s*页\s*$') then 'page' when regexp_matches(x, '蔬菜病虫害诊断[与于]防治原色图谱') then 'title' when regexp_matches(x, '(?i)QR|二维码|扫码') then 'qr'
  when regexp_matches(x, '(?i)^(?:[A-Za-z]:)?[/\\].+\.(?:jpg|jpeg|png|bmp|gif|webp|tiff?)\s*$') then 'path' end r from s),
f as (select block_id, arg_min(r, n * 100000 + m) r from h where r is not null group by 1),
q as (select b.block_id, b.type, case when lower({SQUEEZE('b.type')}) in ('header', 'page_number') then 'type:' || lower({SQUEEZE('b.type')}) when f.r is not null then 'pattern:' || f.r end reason from b left join f using (block_id))
"""
_SAID = "case when type = 'text' then case when coalesce(text_level, 0) > 0 then repeat('#', text_level) || ' ' || coalesce(text, '') else coalesce(text, '') end else '' end"
_SHOWN = "case when coalesce(len({0}), 0) = 0 then 'None' else array_to_string({0}, ', ') end"
_IMAGE = "chr(10) || 'Image Content Analysis:' || chr(10) || 'Image Path: ' || coalesce({0}, '') || chr(10) || 'Captions: ' || " + _SHOWN.format("image_caption") + " || chr(10) || 'Footnotes: ' || " + _SHOWN.format("image_footnote") + " || chr(10) || chr(10) || 'Visual Analysis: '"
_IMAGE_ZH = "chr(10) || '图片内容分析：' || chr(10) || '图片路径：' || coalesce({0}, '') || chr(10) || '标注：' || " + _SHOWN.format("image_caption") + " || chr(10) || '脚注：' || " + _SHOWN.format("image_footnote") + " || chr(10) || chr(10) || '视觉分析：'"
_GRID = "'Table Analysis:' || chr(10) || 'Image Path: ' || coalesce(img_path, '') || chr(10) || 'Caption: ' || " + _SHOWN.format("table_caption") + " || chr(10) || 'Structure: ' || coalesce(table_body, '') || chr(10) || 'Footnotes: ' || " + _SHOWN.format("table_footnote") + " || chr(10) || chr(10) || 'Analysis: '"
_PAIR = lambda name, value: f"""case when {name} is not null then '"{name}": ' || {value} end"""
_LIST = lambda c: f"'[' || array_to_string(list_transform({c}, lambda x: coalesce(to_json(x)::varchar, 'null')), ', ') || ']'"
_ITEMS = _B + f""", it as (select *, row_number() over (partition by file_path order by block_idx, block_id) - 1 i from b where type <> 'text'),
ih as (select file_path, block_idx, i item_idx, md5('{{' || concat_ws(', ', {_PAIR('image_caption', _LIST('image_caption'))}, {_PAIR('image_footnote', _LIST('image_footnote'))}, {_PAIR('img_path', 'to_json(img_path)::varchar')}, '"index": ' || i, {_PAIR('page_idx', 'page_idx')}, {_PAIR('table_body', 'to_json(table_body)::varchar')},
  {_PAIR('table_caption', _LIST('table_caption'))}, {_PAIR('table_footnote', _LIST('table_footnote'))}, {_PAIR('text', 'to_json(text)::varchar')}, {_PAIR('type', 'to_json(type)::varchar')}) || '}}') item_hash from it)"""
ORACLE_SQL = {
    "block_filter_report": _REASON + "select coalesce(reason, 'kept') reason, count(*) n_blocks from q group by 1",
    "block_filtered": _REASON + "select block_id, type from q where reason is null",
    "block_separation": _B + f"""select file_path, length(t) n_chars, md5(t) digest, n_multimodal from (
      select file_path, coalesce(string_agg(text, chr(10) || chr(10) order by block_idx, text) filter (coalesce(type, 'text') = 'text' and {SQUEEZE('text')} <> ''), '') t,
      count(*) filter (coalesce(type, 'text') <> 'text') n_multimodal from b group by 1)""",
    "block_types": _B + "select file_path, type, count(*) n from b group by 1, 2",
    "block_page_context": _B + f""", s as (select file_path, page_idx, block_idx, {_SAID} said from b where type = 'text'),
      p as (select distinct file_path, page_idx from b)
      select p.file_path, p.page_idx, length(coalesce(c, '')) n_chars, md5(coalesce(c, '')) digest from p left join (
      select p.file_path, p.page_idx, string_agg(case when s.page_idx <> p.page_idx then '[Page ' || s.page_idx || '] ' || said else said end, chr(10) order by s.page_idx, s.block_idx, said) c
      from p join s on s.file_path = p.file_path and s.page_idx between p.page_idx - 1 and p.page_idx + 1 where trim(said) <> '' group by 1, 2) x on x.file_path = p.file_path and x.page_idx = p.page_idx""",
    "block_chunk_context": _B + f""", s as (select file_path, block_idx, case when type = 'text' and trim({_SAID}) <> '' then {_SAID} end said, row_number() over (partition by file_path order by block_idx) r from b)
      select a.file_path, a.block_idx, md5(coalesce(string_agg(n.said, chr(10) order by n.r), '')) digest from s a left join s n on n.file_path = a.file_path and n.r between a.r - 2 and a.r + 2 and n.r <> a.r group by a.file_path, a.block_idx, a.r""",
    "block_text_truncated": _B + """, h as (select block_id, text, text[1:60] head, length(text[1:60]) n from b where type = 'text' and text is not null),
      p as (select *, case when contains(head, '.') then n - strpos(reverse(head), '.') else -1 end stop, case when contains(head, chr(10)) then n - strpos(reverse(head), chr(10)) else -1 end line from h)
      select block_id, case when length(text) <= 60 then text when stop > n * 0.8 then head[1:stop + 1] when line > n * 0.8 then head[1:line] else head || '...' end head from p""",
    "block_chunks": _B + f"""select 'chunk-' || md5(case when type = 'image' then {_IMAGE.format('img_path')} when type = 'table' then 'Table Analysis:' || chr(10) || 'Image Path: ' || coalesce(img_path, '') || chr(10) || 'Caption: ' || {_SHOWN.format('table_caption')} || chr(10) || 'Structure: ' || coalesce(table_body, '') || chr(10) || 'Footnotes: ' || {_SHOWN.format('table_footnote')} || chr(10) || chr(10) || 'Analysis: '
      else case type when 'header' then 'Header' when 'page_number' then 'Page_number' else type end || ' Content Analysis:' || chr(10) || 'Content: ' || coalesce(text, '') || chr(10) || chr(10) || 'Analysis: ' end) chunk_id,
      file_path, block_idx, page_idx, type original_type from b where coalesce(type, 'text') <> 'text'""",
    "block_chunks_zh": _B + f""", z as (select *, case when type = 'image' then {_IMAGE_ZH.format('img_path')} || coalesce(image_caption[1], '') else 'Header内容分析：' || chr(10) || '内容：' || coalesce(text, '') || chr(10) || chr(10) || '分析：' || coalesce(image_caption[1], '') end t from b where type in ('image', 'header'))
      select 'chunk-' || md5(t) chunk_id, file_path, block_idx, length(t) n_chars from z""",
    "block_document_ids": _B + """, k as (select file_path, block_idx, case when type = 'text' then trim(coalesce(text, ''), ' ') when type = 'image' then 'image:' || coalesce(img_path, '') when type = 'table' then 'table:' || coalesce(table_body, '') else type || ':' || coalesce(text, '') end k from b)
      select file_path, 'doc-' || md5(coalesce(string_agg(md5(k), chr(10) order by block_idx, md5(k)) filter (k <> ''), '')) doc_id from k group by 1""",
    "block_item_hashes": _ITEMS + " select file_path, block_idx, item_idx::int item_idx, item_hash from ih",
    "block_signatures": _ITEMS + " select file_path, md5(string_agg(item_hash, '||' order by item_idx)) signature, count(*) n_items from ih group by 1",
    "block_paths": _B + r"""select block_id, regexp_extract(img_path, '([^/\\]*)$', 1) file_name, lower(regexp_extract(img_path, '(\.[^./\\]+)$', 1)) suffix, regexp_matches(lower(img_path), 'qr|二维码') qr from b where img_path is not null""",
    "block_scripts": _B + r"""select file_path, count(*) filter (regexp_matches(text, '[\x{4e00}-\x{9fff}]')) n_cjk, count(*) filter (regexp_matches(text, '[A-Za-z]{2,}')) n_ascii, sum(length(text))::bigint n_chars from b where text is not null group by 1""",
    "chunk_image_paths": _B + f""", w as (select * replace (regexp_replace(img_path, '^(.{{3}})', '\\1 ') as img_path) from b where type = 'image'), t as (select {_IMAGE.format('img_path')} t from w union select {_IMAGE_ZH.format('img_path')} from w)
      select distinct 'chunk-' || md5(t) chunk_id, unnest(regexp_extract_all(t, '(?i)(?:Image\\s*Path|图片路径)\\s*[:：]\\s*([^\\n\\r]*?\\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif))', 1)) img_path from t""",
}
