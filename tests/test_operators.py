import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindle.operators import blocks as B, documents as D, evaluation as E, graph as G, retrieval as R, state as S
from spindle.operators.records import first_version, latest_version, upsert
from spindle.operators.references import ParentSource, ReferenceSource, orphan_references, orphan_report

T0 = dt.datetime(2024, 1, 1)
DAY = dt.timedelta(days=1)


def refs(spark, records, parents):
    r = spark.createDataFrame(records, "id string, keys array<string>, created_at timestamp_ntz, ingested_at timestamp_ntz, status string, ref_key string")
    p = spark.createDataFrame(parents, "k string, gone boolean, ingested_at timestamp_ntz, parent string")
    return orphan_references(
        [ReferenceSource("t", r, F.col("id"), F.col("keys"), "p")], [ParentSource("p", p, F.col("k"), F.col("gone"), F.col("ingested_at"))]
    )


def test_orphans(spark):
    records = [
        ("a", ["Here ", "gone", "late", "none", "none", None, " ", ".\\X/y"], T0, T0, "clash", "clash"),
        ("a", ["Here ", "gone", "late", "none", "none", None, " ", ".\\X/y"], T0, T0 + DAY, "clash", "clash"),
        ("b", None, T0, T0, "", ""), (None, ["none"], T0, T0, "", ""), ("c", ["back", "half"], None, T0, "", ""),
    ]
    parents = [("here", False, T0, "x"), ("gone", False, T0 - DAY, "x"), ("GONE", True, T0, "x"), ("late", None, T0 + DAY, "x"), ("back", True, T0 - DAY, "x"), ("back", False, T0, "x"), ("half", False, T0, "x"), ("half", True, T0, "x")]
    got = {tuple(r) for r in refs(spark, records, parents).collect()}
    assert got == {("t", "a", "gone", "deleted", "2024-01"), ("t", "a", "late", "late", "2024-01"), ("t", "a", "none", "missing", "2024-01"), ("t", "a", "x/y", "missing", "2024-01"), ("t", "c", "half", "deleted", None)}


def test_orphans_of_empty_tables(spark):
    assert refs(spark, [], []).count() == 0
    assert [r["status"] for r in refs(spark, [("a", ["k"], T0, T0, "", "")], []).collect()] == ["missing"]
    assert orphan_report(refs(spark, [("a", ["k"], T0, T0, "", "")], [])).first()["n_records"] == 1


def test_orphans_against_brute_force(spark):
    rng = np.random.default_rng(5)
    parents = [(f"k{rng.integers(30)}", bool(rng.integers(2)), T0 + int(rng.integers(9)) * DAY, "") for _ in range(90)]
    hot = ["k0"] * 60 + [f"k{i}" for i in rng.integers(0, 45, 120)]  # one key holds a third of the references
    records = [(f"r{i}", [k], T0, T0 + int(rng.integers(9)) * DAY, "", "") for i, k in enumerate(hot)]
    want = set()
    for i, keys, made, seen, *_ in records:
        v = [(at, gone) for k, gone, at, _ in parents if k == keys[0]]
        s = "missing" if not v else "deleted" if max(v)[1] else "late" if min(v)[0] > seen else None
        if s:
            want.add(("t", i, keys[0], s, "2024-01"))
    assert {tuple(r) for r in refs(spark, records, parents).collect()} == want


def test_versions(spark):
    df = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 5), (1, "b", 2)], "k int, v string, at int")
    assert {tuple(r) for r in first_version(df, "k", order="at").select("k", "v").collect()} == {(1, "a"), (2, "c")}
    assert {tuple(r) for r in latest_version(df, "k", order="at").select("k", "v").collect()} == {(1, "b"), (2, "c")}
    up = upsert(df, spark.createDataFrame([(2, "z", 9)], df.schema), "k", order="at")
    assert {tuple(r) for r in up.select("k", "v").collect()} == {(1, "b"), (2, "z")}
    assert first_version(df.limit(0), "k", order="at").count() == 0


BLOCK = "block_id int, file_path string, block_idx int, type string, text string, text_level int, page_idx int, img_path string, image_caption array<string>, image_footnote array<string>, table_caption array<string>, table_footnote array<string>, table_body string"


def blocks(spark):
    none = [None] * 4
    return spark.createDataFrame(
        [
            (1, "f", 0, "text", "Title", 1, 0, None, *none, None), (2, "f", 1, "text", " 12 ", None, 0, None, *none, None), (3, "f", 2, "header", "Book", None, 0, None, *none, None),
            (4, "f", 3, "image", None, None, 1, "a/qrcode.png", ["cap"], None, None, None, None), (5, "f", 4, "image", None, None, 1, "b.png", ["leaf", "stem"], None, None, None, None),
            (6, "f", 5, "text", "  ", None, 2, None, *none, None), (7, "f", 6, "text", "End.", None, 2, None, *none, None), (8, "f", 7, None, "loose", None, 2, None, *none, None),
            (9, "f", 8, "text", "/x/y.png", None, 3, None, *none, None),
        ], BLOCK,
    )


def test_blocks(spark):
    b = blocks(spark)
    why = {r["block_id"]: r["r"] for r in b.select("block_id", B.drop_reason().alias("r")).collect()}
    assert why == {1: None, 2: "pattern:number", 3: "type:header", 4: "pattern:qr", 5: None, 6: None, 7: None, 8: None, 9: "pattern:path"}
    s = B.separate(b).first()
    assert s["text"] == "Title\n\n 12 \n\nEnd.\n\nloose\n\n/x/y.png" and s["n_multimodal"] == 3
    pages = {r["page_idx"]: r["context"] for r in B.page_context(b).collect()}
    assert pages[0] == "# Title\n 12 " and pages[1] == "[Page 0] # Title\n[Page 0]  12 \n[Page 2] End."
    near = {r["block_idx"]: r["context"] for r in B.chunk_context(b, 1).collect()}
    assert near[1] == "# Title" and near[0] == " 12 "
    # every type but text has a template
    assert B.multimodal_chunks(b).count() == 3 and B.document_ids(b).first()["doc_id"].startswith("doc-") and D.signatures(D.item_hashes(b)).first()["n_items"] == 3
    assert B.separate(b.limit(0)).count() == 0


def test_components_against_union_find(spark):
    rng = np.random.default_rng(1)
    pairs = [(int(a), int(b)) for a, b in rng.integers(0, 120, (90, 2))] + [(i, i + 1) for i in range(200, 260)] + [(300, i) for i in range(301, 340)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {r["node"]: r["component"] for r in G.components(spark.createDataFrame(pairs, "a int, b int")).collect()}
    assert got == {x: find(x) for x in root}


def test_similar_names_against_all_pairs(spark):
    from collections import Counter

    from spindle.functions.udfs import ratio

    def cosine(a, b):
        x, y = (Counter(t[i : i + 2] for i in range(max(1, len(t) - 1))) for t in (a, b))
        return sum(x[g] * y[g] for g in x) / (sum(v * v for v in x.values()) * sum(v * v for v in y.values())) ** 0.5

    rng = np.random.default_rng(3)
    names = sorted({"".join(rng.choice(list("甲乙丙丁"), rng.integers(1, 9))) for _ in range(90)} | {"aaaa", "aa", "甲乙甲乙甲乙", "甲乙", "x"})
    df = spark.createDataFrame([("k", "虫害", n) for n in names], "kb_id string, entity_type string, name string")
    got = {(r["a"], r["b"]): round(r["similarity"], 6) for r in G.similar_names(df, 0.8).collect()}
    want = {(a, b): round(max(ratio(a, b), cosine(a, b)), 6) for i, a in enumerate(names) for b in names[i + 1 :]}
    assert got == {k: v for k, v in want.items() if v >= 0.8} and ("aa", "aaaa") in got and ("甲乙", "甲乙甲乙甲乙") in got
    assert G.similar_names(df.limit(0), 0.8).count() == 0


def test_merges(spark):
    n = spark.createDataFrame([(1, "k", "蚜虫 (image)", "其他", "", ["c1"]), (2, "k", "蚜虫", "虫害", "said", ["c2<SEP>c1", None]), (3, "k", None, None, None, None)], "node_id int, kb_id string, id string, entity_type string, description string, source_ids array<string>")
    m = G.merge_nodes(n.filter(F.col("id").isNotNull()), "node_id").collect()
    assert len(m) == 1 and m[0]["entity_type"] == "虫害" and m[0]["source_ids"] == ["c1", "c2"] and m[0]["description"] == "said"
    e = spark.createDataFrame([(1, "k", "a", "a2"), (2, "k", "a", "b")], "edge_id int, kb_id string, source string, target string")
    names = spark.createDataFrame([("k", "a2", "a")], "kb_id string, name string, canonical string")
    assert [(r["source"], r["target"]) for r in G.remap(e, names).collect()] == [("a", "b")]


def test_vector_search_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(120, 8))
    v[7] = 0
    df = spark.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(v)], "vec_id long, embedding array<float>")
    q = df.filter("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    got = {(r["query_id"], r["rank"]): r["vec_id"] for r in R.vector_top_k(q, df, 5, -1.0, exclude_own=True).collect()}
    u = v.astype(np.float32).astype(float) / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)
    for i in range(0, 120, 20):
        s = [(-float(u[i] @ u[j]), j) for j in range(120) if j not in (i, 7)]
        assert [got[i, k] for k in range(1, 6)] == [j for _, j in sorted(s)[:5]]


def test_vector_search_of_other_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (3, [1.0, 0.1]), (4, None), (5, [0.0, 0.0]), (6, [1.0])], "vec_id long, embedding array<float>")
    q = spark.createDataFrame([(3, [1.0, 0.0]), (9, None), (8, [0.0, 0.0])], "query_id long, embedding array<float>")
    assert [(r["query_id"], r["vec_id"], r["rank"]) for r in R.vector_top_k(q, df, 5).orderBy("rank").collect()] == [(3, 0, 1), (3, 3, 2)]
    assert R.vector_top_k(q.limit(0), df, 5).count() == 0 and R.vector_top_k(q, df.limit(0), 5).count() == 0
    many = spark.range(200).selectExpr("id query_id", "array(cast(cos(id) as float), cast(sin(id) as float)) embedding")
    one = {tuple(r) for r in R.vector_top_k(many, df, 2, -1.0).collect()}
    sent, R.SENT = R.SENT, 1000
    try:
        assert {tuple(r) for r in R.vector_top_k(many, df, 2, -1.0).collect()} == one and len(one) == 400
    finally:
        R.SENT = sent


def test_contexts_of_many_pages(spark):
    # ranges of the order meet where a window crosses them
    b = spark.range(2500).selectExpr("'f' file_path", "cast(id as int) block_idx", "id block_id", "cast(id as int) page_idx", "'text' type", "concat('t', id) text", "0 text_level", "cast(null as array<string>) image_caption", "cast(null as array<string>) table_caption")
    pages = {r["page_idx"]: r["context"] for r in B.page_context(b).collect()}
    assert len(pages) == 2500 and pages[999] == "[Page 998] t998\nt999\n[Page 1000] t1000" and pages[1000] == "[Page 999] t999\nt1000\n[Page 1001] t1001"
    near = {r["block_idx"]: r["context"] for r in B.chunk_context(b.withColumn("block_idx", F.col("block_idx") * 7), 2).collect()}
    assert len(near) == 2500 and near[7 * 1000] == "t998\nt999\nt1001\nt1002" and near[0] == "t1\nt2"


def test_lists_budget_and_scores(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2)], "query_id int, item string, rank int")
    b = spark.createDataFrame([(1, "y", 1), (1, "z", 2)], a.schema)
    assert [r["item"] for r in R.round_robin([a, b], "item").orderBy("position").collect()] == ["x", "y", "z"]
    p = spark.createDataFrame([(1, 1, "abcd"), (1, 2, "efgh"), (1, 3, "ij")], "q int, r int, t string")
    assert [r["t"] for r in R.within_budget(p, "q", "r", "t", 6).orderBy("r").collect()] == ["abcd", "ef"]
    s = spark.createDataFrame([(["a", "b"], ["b", "c", "c"]), ([], ["a"]), (["a"], [])], "gold array<string>, found array<string>")
    assert [(r["hit"], r["recall"], r["precision"], r["f1"]) for r in E.retrieval_scores(s).collect()] == [(1, 0.5, 0.5, 0.5), (0, 0.0, 0.0, 0.0), (0, 0.0, 0.0, 0.0)]


def test_selection_and_quotas(spark):
    df = spark.createDataFrame([(f"s{i}", "image" if i > 7 else "text", i % 5, 1.0) for i in range(10)], "id string, modality string, judge_score int, evidence_score double")
    got = {r["id"] for r in E.select_accepted(df, 4, 0.5).collect() if r["accepted"]}
    assert {"s8", "s9"} <= got and len(got) == 4
    assert E.scaled_quotas({"a": 3, "b": 1}, 10) == {"a": 8, "b": 2} or sum(E.scaled_quotas({"a": 3, "b": 1}, 10).values()) == 10
    n = spark.createDataFrame([("g", x) for x in [5, 1, 3, None]], "g string, x int")
    r = E.nearest_rank(n, "g", "x").first()
    assert (r["n"], r["at_rank"]) == (3, 3)


def test_state(spark):
    e = spark.createDataFrame([(1, T0, 1, "click", 2.0), (2, T0 + DAY, 1, "view", None), (3, T0 + DAY, 1, "purchase", 1.0)], "event_id long, ts timestamp_ntz, user_id long, event_type string, value double")
    assert S.latest_status(e).first()["status"] == "purchase" and S.progress(e, {"purchase": 190, "view": 10}).first()["progress"] == 100
    assert S.windowed_counts(e).count() == 3 and S.event_metrics(e.limit(0)).count() == 0


def test_focused_subgraph(spark):
    n = spark.createDataFrame([(i, kb, f"n{i}", keys) for i, kb, keys in [(1, "a", ["c1"]), (2, "a", []), (3, "a", ["x"]), (4, "b", []), (5, "b", None), (6, None, ["c1"])]], "node_id long, kb_id string, id string, source_ids array<string>")
    e = spark.createDataFrame([(1, "a", "n1", "n2", ["c1"]), (2, "a", "n1", "n3", []), (3, "b", "n4", "n5", None), (4, "b", "n4", "gone", None)], "edge_id long, kb_id string, source string, target string, source_ids array<string>")
    c = spark.createDataFrame([("c1",), ("c1",)], "chunk_id string")
    show = lambda g: [sorted((tuple(r) for r in x.collect()), key=str) for x in g]
    nodes, edges = show(G.focused_subgraph(n, e, c))
    assert nodes == [("a", 1, True), ("a", 2, False), ("b", 4, False), ("b", 5, False), (None, 6, True)] or (None, 6, True) not in nodes
    assert [x[:2] for x in nodes if x[0]] == [("a", 1), ("a", 2), ("b", 4), ("b", 5)] and edges == [("a", 1, True), ("b", 3, False)]
    nodes, edges = show(G.focused_subgraph(n, e, c.limit(0), most_nodes=1))
    assert [x[:2] for x in nodes if x[0]] == [("a", 1), ("b", 4)] and edges == []
    nodes, edges = show(G.focused_subgraph(n, e, c, whole=True))
    assert len(nodes) == 6 and len(edges) == 4 and sum(x[2] for x in nodes) == 2


def test_chunks_by_vector(spark):
    h = spark.createDataFrame([(1, ["a", "b", "z", "none"]), (1, ["a"])], "query_id int, source_ids array<string>")
    q = spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, embedding array<float>")
    v = spark.createDataFrame([("a", [1.0, 1.0]), ("b", [2.0, 0.0]), ("z", [0.0, 0.0]), ("other", [1.0, 0.0])], "chunk_id string, embedding array<float>")
    assert [(r["chunk_id"], r["rank"]) for r in R.by_vector(h, q, v).orderBy("rank").collect()] == [("b", 1), ("a", 2)]
    assert R.by_vector(h, q, v, most=1).count() == 1 and R.by_vector(h.limit(0), q, v).count() == 0


def test_components_of_a_long_chain(spark):
    pairs = spark.range(300).selectExpr("id a", "id + 1 b").unionByName(spark.range(1000, 1200).selectExpr("cast(1000 as long) a", "id b"))
    got = {r["node"]: r["component"] for r in G.components(pairs).collect()}
    assert len(got) == 301 + 200 and {v for k, v in got.items() if k <= 300} == {0} and {v for k, v in got.items() if k >= 1000} == {1000}
