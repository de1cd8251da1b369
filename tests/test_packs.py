import pytest

from spindle.operators import evaluation as E, packs as P, runs as R

LONG = "白菜的病害。" + "小菜蛾危害叶片，叶片穿孔；" * 3 + "无关。防治小菜蛾用药。"


@pytest.fixture(scope="module")
def kb(spark):
    n = spark.createDataFrame([(1, "k", "小菜蛾", "虫害", ["c1<SEP>c2", "c1", "none"]), (2, "k", "白菜", "作物", ["c1"]), (3, "k", "别的", "其他", ["c1"]), (4, "k", "空", "作物", None)], "node_id long, kb_id string, id string, entity_type string, source_ids array<string>")
    e = spark.createDataFrame([(1, "k", "小菜蛾", "白菜", "危害", ["c2"]), (2, "k", "小菜蛾", None, None, None), (3, "k", "别的", "小菜蛾", "", ["c1"]), (4, "k", "小菜蛾", "小菜蛾", "x", [])], "edge_id long, kb_id string, source string, target string, relation_type string, source_ids array<string>")
    c = spark.createDataFrame([("c1", LONG, "f"), ("c2", "图片路径: a.png 小菜蛾很小。", "g"), ("c3", " ", "g"), ("c4", None, "g")], "chunk_id string, content string, file_path string")
    return n, e, c


def test_quotes(spark):
    rows = [(1, LONG, ["小菜蛾"]), (2, LONG, ["危害"]), (3, None, ["x"]), (4, LONG, None), (5, "没有。", ["小菜蛾"]), (6, "一" * 900 + "小菜蛾" + "二" * 900, ["小菜蛾"])]
    q = {r["i"]: r["q"] for r in P.with_quote(spark.createDataFrame(rows, "i int, content string, terms array<string>"), "content", "terms", "q").collect()}
    assert q[1] == "小菜蛾危害叶片，叶片穿孔；" * 2 and q[2] == q[3] == q[4] == q[5] == ""
    assert q[6].startswith("...") and q[6].endswith("...") and len(q[6]) == 426 and "小菜蛾" in q[6]


def test_packs(spark, kb):
    p = {r["pack_id"]: r for r in P.entity_packs(*kb).collect()}
    assert set(p) == {"entity::k::小菜蛾", "entity::k::白菜"}
    a = p["entity::k::小菜蛾"]
    assert a["expected_entities"] == ["小菜蛾", "白菜", "别的"] and a["expected_relations"] == ["危害", "x"] and [x["chunk_id"] for x in a["evidence"]] == ["c1", "c2"] and a["context"].startswith("[c1] ") and a["n_evidence"] == 2
    r = {x["pack_id"]: x for x in P.relation_packs(*kb).collect()}
    assert set(r) == {"relation::1::小菜蛾::白菜", "relation::3::别的::小菜蛾"} and r["relation::3::别的::小菜蛾"]["expected_relations"] == ["相关"]
    m = spark.createDataFrame([(1, "a.png", "小菜蛾", ["白菜", "谁"]), (2, "b.png", "谁", []), (3, "c.png", None, ["白菜"]), (4, "d.png", "", None)], "image_id int, image_path string, target string, labels array<string>")
    i = {x["pack_id"]: x for x in P.image_packs(m, kb[0], kb[2]).collect()}
    assert set(i) == {"image::1", "image::3"} and i["image::1"]["expected_entities"] == ["小菜蛾", "白菜"] and i["image::3"]["core_entity"] == "白菜"
    assert P.entity_packs(kb[0].limit(0), kb[1], kb[2]).count() == 0
    long = spark.createDataFrame([("p", ["c1"] * 1 + [f"c{i}" for i in range(10, 40)], ["小菜蛾"])], "pack_id string, source_ids array<string>, terms array<string>")
    many = spark.createDataFrame([(f"c{i}", "小菜蛾" + "很" * 200 + "。", "f") for i in [1, *range(10, 40)]], "chunk_id string, content string, file_path string")
    got = P.evidence_of(long, many).first()
    assert got["n_evidence"] == 31 and len(got["evidence"]) == 3 and sum(len(x.partition("] ")[2]) for x in got["context"].split("\n")) == P.CONTEXT


def test_quotas_and_sampling(spark):
    base = {"a": 45, "b": 45, "c": 35, "d": 35, "i": 30, "u": 10}
    q = P.image_quotas(E.scaled_quotas(base, 100), 100, "i", 0.3)
    assert sum(q.values()) == 100 and q["i"] == 30 and q["u"] == 2 and P.image_quotas({"i": 5, "a": 5}, 10, "i", 0.3) == {"i": 5, "a": 5}
    t = spark.createDataFrame([("a", f"p{i}") for i in range(7)] + [("b", "q")], "task string, pack_id string")
    s = P.sampled_packs(t, {"a": 17, "b": 3, "c": 2, "d": 0}).collect()
    a = sorted((r["number"], r["pack_id"]) for r in s if r["task"] == "a")
    assert [n for n, _ in a] == list(range(1, 18)) and {p for _, p in a[:7]} == {p for _, p in a[7:14]} == {f"p{i}" for i in range(7)} and len(s) == 20
    few = P.sampled_packs(t, {"a": 3}).collect()
    assert sorted(r["pack_id"] for r in few) == sorted(p for n, p in a if n <= 3)
    n = {r["number"]: r["sample_id"] for r in P.numbered(spark.createDataFrame([("a", 7), ("z", 12345)], "task string, number long"), {"a": "diag"}).collect()}
    assert n == {7: "diag_0007", 12345: "qa_12345"}


def sample(i, modality="text", reason="judge_rejected", judge=10, question="q", answer="a", path=None):
    return (i, "t", modality, question, path, answer, [("c", "q", "f")], ("e", None), ("rejected", reason, [reason], 1.0, 1.0, judge, None))


def test_promotion(spark):
    df = lambda *rows: spark.createDataFrame(list(rows), R.SAMPLE)
    accepted, rejected = df(sample("1", judge=18), sample("2", judge=16), sample("3", judge=16), sample("4", "image")), df(sample("5", "image"), sample("6"), sample("7", "image", "other"), sample("8", "image", answer=" "))
    a, r = R.promote(accepted, rejected, keep_size=True)
    assert {x["id"] for x in a.collect()} == {"1", "2", "4", "5"} and {x["id"]: x["quality"]["reason"] for x in r.collect()}["3"] == "judge_rejected|over_target_size"
    a, r = R.promote(accepted, rejected, spark.createDataFrame([("7",)], "id string"), auto=False)
    assert a.count() == 5 and {x["id"]: x["quality"]["status"] for x in a.collect()}["7"] == "accepted"
    with pytest.raises(ValueError):
        R.promote(accepted, rejected, spark.createDataFrame([("8",)], "id string"))
    with pytest.raises(ValueError):
        R.promote(accepted.limit(0), rejected, keep_size=True)
    m = spark.createDataFrame([("x.png", "n", ["l"])], "image_path string, notes string, labels array<string>")
    base = df(sample("5", "image", path="x.png"), sample("6"), sample("9", "image", path=" y"), sample("e", "image", path="z", question="err"))

    def verify(s):
        if s["question"] == "err":
            raise RuntimeError("x" * 400)
        return {"match": s["notes"] == "n"}

    out = {x["id"]: x for x in R.rejudged(base, m, verify, lambda s: {"evidence_consistency": 5, "safety": "7"}).collect()}
    assert {k: v["outcome"] for k, v in out.items()} == {"5": "promoted", "6": "untouched", "9": "still_rejected", "e": "error"}
    assert out["5"]["quality"]["judge_score"] == 16 and out["5"]["metadata"]["image_match"]["match"] and out["e"]["quality"] == base.filter("id = 'e'").first()["quality"] and len(out["e"]["error"]) == 300


def test_runs(spark):
    s = spark.createDataFrame([sample("1"), sample("2", question="bad"), sample("3", "image")], R.SAMPLE)

    def answer(x):
        if x["question"] == "bad":
            raise RuntimeError("y" * 900)
        return {"answer": " yes ", "chunk_ids": ["c", "d"]}

    r = R.evaluated(s, answer, lambda x, said: {k: 4 for k in R.CRITERIA}, clock=lambda: 1.0)
    got = {x["id"]: x for x in r.collect()}
    assert got["1"]["total_score"] == 20 and got["1"]["pass"] and got["1"]["precision"] == 0.5 and got["1"]["recall"] == 1.0 and len(got["2"]["error"]) == 500 and got["2"]["total_score"] is None
    report = {x["modality"]: x for x in R.run_report(r, "modality").collect()}
    assert report["text"]["pass_rate"] == 1.0 and report["text"]["error_count"] == 1 and report["text"]["avg_total_score"] == 20.0
    assert R.run_summary(r).first()["samples"] == 3 and R.run_report(r.limit(0), "modality").count() == 0
    assert E.review_sheet(s).columns[-2:] == ["manual_decision", "manual_notes"] and len(E.review_sheet(s).columns) == 14
    flat = E.flat_evidence(s)
    assert flat.columns == sorted(flat.columns) and "quality_judge_safety" in flat.columns and flat.count() == 3


def test_building(spark):
    p = spark.createDataFrame(
        [("a1", "t", "e1", "虫害", "c", "text", ["e"], ["r"], [("c1", "q", "f")]), ("a2", "t", "bad", "虫害", "c", "text", [], [], [("c1", "q", "f")]), ("a3", "t", "e3", "虫害", "c", "image", [], [], [("c1", "q", "f")]), ("a4", "t", "e4", "x", "c", "text", [], [], [("zz", "q", "f")]), ("a5", "t", "e5", "x", "c", "text", [], [], [])],
        "sample_id string, task string, core_entity string, entity_type string, context string, modality string, expected_entities array<string>, expected_relations array<string>, evidence array<struct<chunk_id:string,quote:string,file_path:string>>",
    )
    known = spark.createDataFrame([("c1",)], "chunk_id string")

    def generate(x):
        if x["core_entity"] == "bad":
            raise ValueError("no")
        return {"question": "q", "gold_answer": "a"}

    s = {x["id"]: x["quality"] for x in R.built_samples(p, generate, lambda x: {"evidence_consistency": 3}, known, lambda x: {"match": False}).collect()}
    assert {k: v["reason"] for k, v in s.items()} == {"a1": "", "a2": "generation_error", "a3": "image_target_mismatch", "a4": "invalid_chunk", "a5": "no_evidence"}
    assert s["a1"]["status"] == "candidate" and s["a1"]["judge_score"] == 12 and s["a4"]["evidence_score"] == 0.7 and s["a2"]["reasons"] == ["generation_error:no"]
    ids = E.sample_ids(spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'a', cast(null as string)) g"), "id", "g").collect()
    assert len({x["sample_id"] for x in ids}) == 3000
    i = spark.createDataFrame([("d/甘蓝_蚜虫-1_2.png",), ("d/placeholder_x_1.png",), ("bad.png",)], "image_path string")
    m = {x["image_path"]: x for x in R.manifest_rows(i, lambda x: {"crop": "芥菜", "confidence": 7, "visible_clues": ["u", "v"]}, "placeholder", ("芥菜",), "甘蓝").collect()}
    assert m["d/甘蓝_蚜虫-1_2.png"]["number"] == "1_2" and m["d/placeholder_x_1.png"]["crop"] == "芥菜" and m["d/placeholder_x_1.png"]["notes"] == "u；v" and m["d/placeholder_x_1.png"]["confidence"] == 1.0 and m["bad.png"]["error"]
