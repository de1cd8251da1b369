import hashlib
import json

import pytest
from pyspark.sql import functions as F, types as T

from spindle.functions import predicates as P
from spindle.functions.udfs import content_key, parse_key, told_field, vision_parts
from spindle.operators import documents as D
from spindle.sources import files, parsers as S


def one(spark, c, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'long' if isinstance(v, int) else 'string'}" for k, v in values.items()) or "x int") if values else spark.range(1)
    return df.select(c.alias("v")).first()["v"]


@pytest.mark.parametrize(
    "text, summary, nothing, empty",
    [
        (None, None, True, True), (" 　", "", True, True), ("N/A", "", True, False), ("{}", None, True, True), ("n/a", "s", False, False), ('{"detailed_description": "", "entity_info": {"summary": ""}}', "", True, True),
        ('```json\n{"detailed_description": "x", "entity_info": {}}\n```', "", False, False), ('{"detailed_description": "", broken "summary": ""', "", True, True), ('{"a": 1}', "", False, True), ("said", "", False, False),
        ('{"detailed_description": "a \\" b"', "", False, False),
    ],
)
def test_descriptions(spark, text, summary, nothing, empty):
    df = spark.createDataFrame([(text, summary)], "t string, s string")
    assert tuple(df.select(P.empty_description(F.col("t"), F.col("s")), P.empty_result(F.col("t"), F.col("s"))).first()) == (nothing, empty)


def test_images_and_paths(spark):
    rows = [("a.png", None, "", "missing_image_file"), ("a.png", 0, "", "empty_image_file"), ("qrcode.png", 5, "", "noise_metadata"), ("a.png", 5, "page 12", "noise_metadata"), ("a.png", 5, "/x/y.jpg", "path_only_metadata"), ("a.png", 5, None, None), ("b.png", 7, "leaf", None)]
    df = spark.createDataFrame(rows, "p string, n long, m string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", P.image_noise(F.col("p"), F.col("n"), F.col("m")).alias("got")).collect())
    assert [r[0] for r in df.select(P.valid_image(F.col("p"), F.col("n"))).collect()] == [False, True, True, True, True, True, True]
    assert one(spark, P.valid_image(F.col("p"), F.lit(5), F.lit(True)), p="a.png") is False
    paths = {"images/a": True, "./images//b/../a": True, "images/../../etc": False, "/kb/x": True, "/kb2/x": False, "..": False, "images": True, "/kb/../etc": False, None: False}
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert {r["p"]: r["ok"] for r in df.select("p", P.within(F.col("p"), ["images/", "/kb"]).alias("ok")).collect()} == paths
    up = spark.createDataFrame([("a.PDF", 3, False), ("a.pdf", 3, True), ("x.exe", 3, False), ("n", 3, False), ("a.md", 0, False)], "n string, b long, t boolean")
    got = up.select(P.upload_verdict(F.col("n"), F.col("b"), F.col("t")), P.upload_name(F.col("n"), F.col("t"), F.col("n"))).collect()
    assert [r[0] for r in got] == ["accepted", "renamed", "suffix", "suffix", "empty"] and got[1][1] == "a_" + hashlib.md5(b"a.pdf").hexdigest()[:6] + ".pdf"


def test_templates(spark):
    df = spark.createDataFrame([("image", "a b.png", ["c", "d"], None, None), ("equation", None, None, "x", None), ("chart", None, None, "t", "said")], "type string, img_path string, image_caption array<string>, text string, content string")
    en = [r[0] for r in df.select(P.chunk_text(F.lit("D"), "en", tuple(df.columns))).collect()]
    assert en[0] == "\nImage Content Analysis:\nImage Path: a b.png\nCaptions: c, d\nFootnotes: None\n\nVisual Analysis: D"
    assert en[1] == "Mathematical Equation Analysis:\nEquation: x\nFormat: \n\nMathematical Analysis: D" and en[2] == "Chart Content Analysis:\nContent: said\n\nAnalysis: D"
    zh = df.select(P.chunk_text(F.lit("D"), "zh", tuple(df.columns)).alias("t"))
    kinds = [r["k"] for r in zh.select(P.chunk_kind(F.col("t")).alias("k")).collect()]
    assert [k["modality"] for k in kinds] == ["image", "equation", "text"] and kinds[0]["image_path"] == "a b.png"
    grid = one(spark, P.chunk_kind(F.col("t")), t="Table Analysis:\nImage Path: i.png\nStructure: <td>\n1")
    assert grid["table_html"] == "<td>\n1" and grid["image_path"] == "i.png" and one(spark, P.chunk_kind(F.col("t")), t="")["modality"] == "text"
    text = one(spark, P.entity_text(F.lit("n"), F.lit(" "), F.lit("d "), F.array(F.lit("a"), F.lit(" ")), F.create_map(F.lit("f"), F.array(F.lit("1"), F.lit("2"))), F.lit(None).cast("string")))
    assert text == "实体:n\n描述:d\n别名:a\n属性:f:1；2"


def test_hashes_equal_json(spark):
    rows = [(1, "f", 0, "image", "a\"b\\\n中", ["x", None], 3, None), (2, "f", 5, "table", None, [], None, "<td>"), (3, "f", 2, "text", "t", None, 1, None), (4, None, 1, "image", None, None, None, None)]
    df = spark.createDataFrame(rows, "block_id long, file_path string, block_idx int, type string, text string, image_caption array<string>, page_idx int, table_body string")
    got = {(r["file_path"], r["item_idx"]): r["item_hash"] for r in D.item_hashes(df).collect()}
    want = [{"type": "image", "text": "a\"b\\\n中", "image_caption": ["x", None], "page_idx": 3, "index": 0}, {"type": "table", "image_caption": [], "table_body": "<td>", "index": 1}]
    digests = [hashlib.md5(json.dumps(w, ensure_ascii=False, sort_keys=True).encode()).hexdigest() for w in want]
    assert [got["f", 0], got["f", 1]] == digests
    s = {r["file_path"]: r["signature"] for r in D.signatures(D.item_hashes(df)).collect()}
    assert s["f"] == hashlib.md5("||".join(digests).encode()).hexdigest() and D.signatures(D.item_hashes(df.limit(0))).count() == 0
    many = spark.range(2500).selectExpr("id block_id", "'g' file_path", "cast(id as int) block_idx", "'image' type", "'t' text")
    assert {r["item_idx"] for r in D.item_hashes(many).collect()} == set(range(2500))


def test_keys():
    options = json.dumps({"lang": "ch", "other": 1, "table": True})
    want = json.dumps({"file_path": "/a/中", "mtime": 1.5, "parser": "p", "parse_method": "auto", "lang": "ch", "table": True}, sort_keys=True)
    assert parse_key("/a/中", 1.5, "p", "auto", options) == hashlib.md5(want.encode()).hexdigest()
    a = content_key(" q ", "mix", json.dumps([{"img_path": "/x/y.png", "table_body": "t" * 201}, 3]), '{"top_k": 1, "z": 2}')
    assert a == content_key("q", "mix", json.dumps([{"img_path": "other/y.png", "table_body": "t" * 201}, 3]), '{"top_k": 1}') and a != content_key("q", "mix", None, None)
    assert told_field({"a": ["1", None, {"b": " 2 "}], "c": "", "d": '["x", "y"]'}) == "a:1；b:2；d:x；y" and told_field("{broken") == "{broken" and told_field(None) == ""
    prompt, images = vision_parts("Image Path: a b.png\nx 图片路径：c.JPG\nImage Path: no.png", {"a b.png": "A", "c.JPG": "C"})
    assert images == ["A", "C"] and prompt == "Image Path: a b.png\n[VLM_IMAGE_1]\nx 图片路径：c.JPG\n[VLM_IMAGE_2]\nImage Path: no.png"


def test_state(spark):
    f = spark.createDataFrame([("a", 1.0, "c"), ("b", 1.0, "c"), ("d", 1.0, "c")], "file_path string, mtime double, config string")
    cache = spark.createDataFrame([("a", 1.0, "c", "id", 2), ("a", 1.0, "c", "id", 2), ("b", 2.0, "c", "id", 2), ("d", 1.0, "c", "", 2), ("d", 1.0, "c", "id", 0)], "file_path string, mtime double, config string, doc_id string, n_blocks int")
    assert {r["file_path"]: r["valid"] for r in D.valid_parses(f, cache).collect()} == {"a": True, "b": False, "d": False}
    now, done = spark.createDataFrame([("a", "s"), ("b", "s")], "file_path string, signature string"), spark.createDataFrame([("a", "s", True), ("b", "t", True), ("b", "s", None)], "file_path string, signature string, completed boolean")
    assert {r["file_path"]: r["skip"] for r in D.hard_skip(now, done).collect()} == {"a": True, "b": False}
    items = spark.createDataFrame([("1",), ("2",), ("3",)], "item_hash string")
    kept = spark.createDataFrame([("1", " ", "", 1), ("1", "old", "", 1), ("1", "new", "", 2), ("2", "", "{e}", 1), ("3", None, " ", 1)], "item_hash string, description string, entity string, version int")
    r = {x["item_hash"]: x for x in D.restored(items, kept, ["item_hash"]).collect()}
    assert r["1"]["description"] == "new" and r["2"]["restored"] and not r["3"]["restored"] and len(r) == 3
    st = spark.createDataFrame([("a", "PROCESSED", 3, True, 2), ("a", "failed", 1, False, 1), ("b", "processed", None, None, 1)], "doc_id string, status string, chunks_count int, multimodal_processed boolean, updated_at int")
    got = {x["doc_id"]: x for x in D.document_statuses(spark.createDataFrame([("a",), ("b",), ("z",)], "doc_id string"), st).collect()}
    assert got["a"]["done"] and got["b"]["text_processed"] and not got["b"]["done"] and got["z"]["status"] == "not_found" and got["z"]["chunks_count"] == 0
    assert [x["done"] for x in D.fully_processed(st).orderBy("doc_id", "updated_at").collect()] == [False, True, False]


def test_appending(spark):
    stored = spark.createDataFrame([("a", ["x", "y"]), ("b", None)], "doc_id string, entity_names array<string>")
    found = spark.createDataFrame([("a", "z", 2), ("a", "y", 0), ("a", "w", 1), ("a", "z", 5), ("a", " ", 0), ("c", "q", 0)], "doc_id string, name string, place int")
    assert {r["doc_id"]: (r["entity_names"], r["count"]) for r in D.merged_names(stored, found).collect()} == {"a": (["x", "y", "w", "z"], 4), "b": ([], 0), "c": (["q"], 1)}
    st = spark.createDataFrame([("a", ["1"], 1), ("b", None, None)], "doc_id string, chunks_list array<string>, chunks_count int")
    new = spark.createDataFrame([("a", "2", 1), ("a", "1", 0), ("c", "9", 0)], "doc_id string, chunk_id string, place int")
    assert {r["doc_id"]: (r["chunks_list"], r["chunks_count"]) for r in D.appended_chunks(st, new).collect()} == {"a": (["1", "1", "2"], 3), "b": ([], 0), "c": (["9"], 1)}
    assert {(r["doc_id"], r["chunk_id"]): r["chunk_order_index"] for r in D.chunk_order(new, st).collect()} == {("a", "1"): 1, ("a", "2"): 2, ("c", "9"): 0}
    c, e = spark.createDataFrame([("c", "m"), ("c", "m"), ("d", None)], "chunk_id string, modal_entity_name string"), spark.createDataFrame([("c", "x"), ("c", "m"), ("d", "y"), ("c", "")], "chunk_id string, name string")
    assert [(r["source"], r["target"], r["weight"]) for r in D.modal_edges(c, e).collect()] == [("x", "m", 10.0)]
    t = spark.range(2200).selectExpr("'d' full_doc_id", "cast(id as int) chunk_order_index", "if(id = 5, ' ', concat('t', id)) content")
    near = {r["chunk_order_index"]: r["context"] for r in D.source_context(t).collect()}
    assert len(near) == 2200 and near[0] == "t1" and near[4] == "t3" and near[1000] == "t999\nt1001" and near[2199] == "t2198"
    assert D.source_context(t, "other").first()["context"] == "" and D.source_context(t.drop("chunk_order_index")).filter("context = 't7'").count() == 1


@pytest.mark.parametrize("text, n, head", [("one two, 三四。", 6, "one two..."), ("", 0, ""), (None, 0, None), ("a b", 2, "a b"), ("ab. x y z", 5, "ab....")])
def test_tokens(spark, text, n, head):
    df = spark.createDataFrame([(text,)], "t string")
    got = df.select(D.token_count(F.col("t")), D.token_truncated(F.col("t"), 2)).first()
    assert tuple(got) == (n, head)


def test_parsers(spark, tmp_path):
    assert list(S.ocr_texts({"rec_texts": [" a ", "a", ""], "text": "t", "more": [[[[0, 1], [2, 3]], ["b", 0.9]], None, 7], "last": {"x": ["c", 0.5], "y": ["d", "e"]}, "texts": [{"text": "f"}]})) == ["a", "a", "t", "f", "b", "c", "d", "e"]
    df = spark.createDataFrame([(1, 0, '[["x", "y"]]'), (1, 1, "plain"), (1, 2, None), (1, 3, " ")], "k int, p int, r string")
    assert [(r["page_idx"], r["line_no"], r["text"]) for r in S.ocr_blocks(df, "k", "r", "p").orderBy("page_idx", "line_no").collect()] == [(0, 0, "x"), (0, 1, "y"), (1, 0, "plain")]
    tree = {"body": {"children": [{"$ref": f"#/texts/{i}"} for i in range(12)] + [{"$ref": "#/groups/0"}]}, "texts": [{"label": "t", "orig": str(i)} for i in range(12)] + [{"label": "formula", "orig": "f", "children": [{"$ref": "#/pictures/0"}]}], "groups": [{"children": [{"$ref": "#/texts/12"}]}], "pictures": [{"caption": "c"}]}
    items = S.tree_items(tree)
    assert [x["page_idx"] for x in items[:12]] == [(i + 2) // 10 for i in range(12)] and [x["type"] for x in items[12:]] == ["equation", "text"] and items[13]["text"] == "[Image processing failed: c]"
    t = spark.createDataFrame([(json.dumps(tree),), ("{}",), ("broken",), (None,), ('{"body": {"children": [{"$ref": "#/texts/9"}]}, "texts": []}',)], "t string")
    assert [len(r[0]) for r in t.select(S.tree_blocks("t")).collect()] == [14, 0, 0, 0, 0]
    html = one(spark, S.html_blocks(F.col("t")), t="<H1 class=x>A &amp; <b>B</b></H1><p> </p><ul><li>c\n d</li></ul><table><tr><td>1</td><th>&lt;</th></tr></table>")
    assert [(x["tag"], x["text"]) for x in html] == [("h1", "A & B"), ("li", "c d"), ("td", "1"), ("th", "<")]
    assert one(spark, S.inline_markup(F.col("t")), t="**b** _i_ a_b_c `x<y` [t](u) ~~s~~") == '<b>b</b> <i>i</i> a_b_c <font name="Courier" size="9" color="darkred">x&lt;y</font> <link href="u" color="blue"><u>t</u></link> <strike>s</strike>'
    md = spark.createDataFrame([("f", "# T\n\n## U \r\nline\n#no")], "file_path string, text string")
    assert [(r["block_idx"], r["text"], r["text_level"]) for r in S.markdown_blocks(md).orderBy("block_idx").collect()] == [(0, "T", 1), (2, "U", 2), (3, "line", None), (4, "#no", None)]
    raw = spark.createDataFrame([("中文".encode(),), ("中文".encode("gbk"),), (b"caf\xe9",), (b"\x81\xff",), (None,)], "b binary")
    assert [r[0] for r in raw.select(S.decoded("b")).collect()] == ["中文", "中文", "café", "\x81ÿ", None]
    paths = spark.createDataFrame([("a.PDF",), ("b.pdf",), ("c.txt",), ("dd.pdf",)], "path string")

    def parse(p):
        if p == "b.pdf":
            raise OSError("x" * 900)
        return [] if p == "dd.pdf" else [{"text": p}]

    out = S.parse_batch(paths, parse, [".pdf"])
    r = S.batch_report(out).first()
    assert (r["n_files"], r["n_ok"], r["success_rate"]) == (3, 1, 33.33) and [x["text"] for x in S.batch_blocks(out).collect()] == ["a.PDF"] and max(len(x["error"]) for x in out.collect()) == 500
    assert S.batch_report(out.limit(0)).first()["success_rate"] == 0 and S.batch_report(S.parse_batch(paths, parse, [".pdf"], dry=True)).first()["n_ok"] == 3


def test_manifests_backups_and_registry(spark, tmp_path):
    schema = T.StructType([T.StructField("image_path", T.StringType()), T.StructField("n", T.IntegerType())])
    rows = [{"image_path": "a", "n": 1}, {"image_path": "b", "n": 2}]
    (tmp_path / "l.json").write_text(json.dumps(rows))
    (tmp_path / "i.json").write_text(json.dumps({"items": rows}))
    (tmp_path / "x.jsonl").write_text("\n".join(map(json.dumps, rows)))
    (tmp_path / "bad.jsonl").write_text("{broken\n")
    for name in ("l.json", "i.json", "x.jsonl"):
        assert files.read_manifest(spark, str(tmp_path / name), schema).count() == 2
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_manifest(spark, str(tmp_path / "bad.jsonl"), schema).collect()
    assert files.backup(spark, str(tmp_path / "none"), "s") is None
    files.backup(spark, str(tmp_path / "l.json"), "s")
    assert (tmp_path / "l.json.bak.s").read_text() == json.dumps(rows)
    listing = spark.createDataFrame([("/a/", "kv_store_text_chunks.json", 3), ("/a", "graph_chunk_entity_relation.graphml", 2), ("/b", "other", 1), ("/k", "kv_store_text_chunks.json", 1)], "working_dir string, file_name string, seen_at int")
    known = spark.createDataFrame([("kb", "/k/", 1)], "kb_id string, working_dir string, created_at int")
    assert [(r["working_dir"], r["created_at"]) for r in files.knowledge_bases(listing, known).collect()] == [("/a", 2), ("/k/", 1)]
    sheet = spark.createDataFrame([("1", 'say "x", y')], "id string, q string")
    files.write_review_sheet(sheet, str(tmp_path / "sheet"))
    part = next(p for p in (tmp_path / "sheet").iterdir() if p.name.startswith("part"))
    assert part.read_bytes() == '﻿"id","q"\r\n"1","say ""x"", y"\r\n'.encode()
