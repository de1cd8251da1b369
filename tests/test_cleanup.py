import json

import pytest

from spindle.functions.udfs import canonical_groups
from spindle.operators import cleanup as C

NODE = "node_id long, kb_id string, id string, entity_type string, description string, source_ids array<string>, file_path string, attributes map<string,string>, created_at int, name string"
EDGE = "edge_id long, kb_id string, source string, target string, relation_type string, description string, source_ids array<string>, file_path string, weight double, created_at int, relation string"


@pytest.fixture(scope="module")
def graph(spark):
    n = [
        (1, "k", "小菜蛾成虫", "虫害", "甲", ["c1<SEP>c2"], "f", {"形态特征": "灰"}, 1, "clash"), (2, "k", " 小菜蛾 ", "其他", "乙<SEP>甲", ["c2", None], "g", None, 5, "clash"), (3, "k", "白菜", "作物", None, None, None, None, None, ""),
        (4, "k", "翅膀灰色", "形态特征", "很长的说明", ["c9"], "f", None, 1, ""), (5, "k", "菜蛾", "虫害", "", [], None, None, 1, ""), (6, "k", None, "虫害", "", [], None, None, 1, ""), (7, None, "x", None, None, None, None, None, None, ""),
        (8, "k", "图 (image)", "image", '{"detailed_description": "", "entity_info": {"summary": ""}}', [], None, None, 1, ""),
    ]
    e = [
        (1, "k", "小菜蛾成虫", "白菜", "damage", "说", ["c1"], "f", 1.0, 1, ""), (2, "k", "小菜蛾", "白菜", "危害", "", ["c2"], "g", 3.0, 2, ""), (3, "k", "翅膀灰色", "小菜蛾", "belongs_to", "d", ["c3"], "h", 1.0, 1, ""),
        (4, "k", "菜蛾", "小菜蛾成虫", "又称", "", None, None, None, None, ""), (5, "k", "白菜", "nobody", "危害", "", None, None, None, None, ""), (6, "k", None, None, None, None, None, None, None, None, ""),
    ]
    return spark.createDataFrame(n, NODE), spark.createDataFrame(e, EDGE)


def test_slots(spark, graph):
    g = C.slots(*graph, name="t-slots")
    n = {r["name"]: r for r in g.nodes.collect()}
    assert n["小菜蛾"]["entity_type"] == "虫害" and n["小菜蛾"]["description"] == ["甲", "乙"] and n["小菜蛾"]["source_ids"] == ["c1", "c2"] and n["小菜蛾"]["file_paths"] == ["f", "g"] and n["小菜蛾"]["created_at"] == 5 and n["小菜蛾"]["n_merged"] == 2
    e = {(r["source"], r["target"], r["relation"]): r for r in g.edges.collect()}
    assert set(e) == {("小菜蛾", "白菜", "危害"), ("翅膀灰色", "小菜蛾", "属类隶属")}
    assert e["小菜蛾", "白菜", "危害"]["weight"] == 3.0 and e["小菜蛾", "白菜", "危害"]["description"] == ["说", "N/A"] and e["小菜蛾", "白菜", "危害"]["keywords"] == ["damage", "危害"]
    facts = {(r["name"], r["field"], r["value"]) for r in g.facts.collect()}
    assert facts == {("小菜蛾", "别名", "小菜蛾成虫"), ("小菜蛾", "形态特征", "灰"), ("菜蛾", "别名", "小菜蛾"), ("小菜蛾", "别名", "菜蛾"), ("图", "别名", "图 (image)")}
    p = C.projected(g)
    assert {r["name"] for r in p.nodes.collect()} == {"小菜蛾", "白菜", "菜蛾"}
    told = [r for r in p.facts.collect() if r["value"] == "很长的说明"]
    assert [(r["name"], r["field"], r["chunk"], r["file"]) for r in told] == [("小菜蛾", "形态特征", "c3", "h")]


def test_remap(spark, graph):
    g = C.projected(C.slots(*graph, name="t-remap"))
    names = spark.createDataFrame([("k", "菜蛾", "小菜蛾"), ("k", "小菜蛾", "小菜蛾")], "kb_id string, name string, canonical string")
    after, counts = C.canonical_remap(g, names)
    assert {r["name"]: r["n_merged"] for r in after.nodes.collect()} == {"小菜蛾": 3, "白菜": 1}
    assert [tuple(r) for r in counts.collect()] == [("k", 1, 0)]
    facts = {(r["name"], r["field"], r["value"]) for r in after.facts.collect()}
    assert ("小菜蛾", "别名", "菜蛾") in facts and not any(v == n and f == "别名" for n, f, v in facts)


def test_groups_and_arbiter(spark):
    rows = [("k", "虫害", f"长名字的虫子{i}号大蛾子", "", [], [], [], None, 1) for i in "一二三"] + [("k", "作物", f"作物{i:02d}号品种的名字很长", "", [], [], [], None, 1) for i in range(13)]
    nodes = spark.createDataFrame(rows, "kb_id string, entity_type string, name string, modality string, description array<string>, source_ids array<string>, file_paths array<string>, created_at int, n_merged int")
    facts = spark.createDataFrame([("k", "长名字的虫子二号大蛾子", "别名", "x", "", "", "")], "kb_id string, name string, field string, value string, chunk string, file string, page string")
    g = C.Graph(nodes, spark.createDataFrame([], "kb_id string, source string, target string, relation string, description array<string>, keywords array<string>, source_ids array<string>, file_paths array<string>, weight double, created_at int, n_merged int"), facts)
    assert C.strict_threshold(0.85) == 0.93 and C.gray_threshold(0.85) == 0.85
    groups = C.gray_groups(g, 0.8)
    found = groups.collect()
    # thirteen alike are no group
    assert len(found) == 1 and [m["name"] for m in found[0]["members"]] == sorted(r[2] for r in rows[:3]) and found[0]["entity_type"] == "虫害"

    def arbiter(kind, members):
        names = [m["name"] for m in members]
        return json.dumps({"groups": [{"canonical": names[1], "members": names[:2], "confidence": 0.9}, {"canonical": names[1], "members": names[1:], "confidence": 1}]}, ensure_ascii=False)

    assert {(r["name"], r["canonical"]) for r in C.arbitrated(groups, arbiter).collect()} == {(found[0]["members"][0]["name"], found[0]["members"][1]["name"]), (found[0]["members"][1]["name"],) * 2}
    assert C.arbitrated(groups, lambda k, m: "no JSON").count() == 0
    assert {r["canonical"] for r in C.chosen_names(g, C.alike_groups(C.similar_names(nodes, 0.8), 12)).collect()} == {"长名字的虫子二号大蛾子"}


def test_answers():
    ok = json.dumps({"groups": [{"canonical": "a", "members": ["a", " b ", "z"], "confidence": "0.95"}, {"canonical": "z", "members": ["a", "b"], "confidence": 1}, {"canonical": "a", "members": ["a"], "confidence": 1}, {"canonical": "a", "members": ["a", "b"], "confidence": 0.1}, 7, {"members": 1}]})
    assert canonical_groups("```json\n" + ok + "\n```", {"a", "b"}) == [("a", ["a", "b"], 0.95)]
    assert canonical_groups(None, set()) == [] and canonical_groups("[]", set()) == [] and canonical_groups('{"groups": 3}', set()) == []


def test_clean_and_preprocess(spark, graph):
    g, counts = C.clean_graph(*graph, arbiter=lambda k, m: "{}", name="t-clean")
    assert {r["name"] for r in g.nodes.collect()} == {"小菜蛾", "白菜", "菜蛾"} and counts.first()["node_pairs"] == 0
    n, e, f = C.preprocessed(graph[0].withColumnRenamed("kb_id", "chunk_id"), graph[1].withColumnRenamed("kb_id", "chunk_id"))
    assert {r["name"] for r in n.collect()} == {"小菜蛾", "白菜", "菜蛾"} and {r["edge_id"] for r in e.collect()} == {1, 2}
    assert ("小菜蛾", "危害症状", "说") in {(r["name"], r["field"], r["value"]) for r in f.collect()}
    n, e, f = C.preprocessed(graph[0].withColumnRenamed("kb_id", "chunk_id"), graph[1].withColumnRenamed("kb_id", "chunk_id"), typed=False)
    assert {r["edge_id"] for r in e.collect()} == {1, 2, 3, 5}
    empty = [x.limit(0) for x in graph]
    g, counts = C.clean_graph(*empty, name="t-empty")
    assert g.nodes.count() == g.edges.count() == g.facts.count() == counts.count() == 0
