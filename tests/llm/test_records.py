import datetime as dt
import re

import numpy as np
import pytest
from spindle.llm.canonical import map_to_canonical, repaired, swap_distance
from spindle.llm.pairs import SentenceEnds, broken_pairs, evidence_report, finalities, joined_edges, judged_pairs, length_limits, shortened_versions
from spindle.llm import canonical, sampling
from spindle.llm.sampling import Source, deficits, sample_by_targets
from spindle.session import written

T0 = dt.datetime(2024, 1, 1)


def pairs(spark, rows):
    full = [(i, q, a, t, T0, "clash", "clash") for i, q, a, t in rows]
    df = spark.createDataFrame(full, "id string, question string, gold_answer string, task_type string, ingested_at timestamp_ntz, key string, early string")
    return {r["id"]: r["defect"] for r in broken_pairs(df, "id", "question", "gold_answer", "task_type").collect()}


SENTENCES = ["留种田若不清除残体，第二年的基数会成倍增加。", "已经倒伏的植株无法恢复，应带出田外集中处理。", "Plants that collapse cannot recover and should be carried out of the field.", "The plots recorded many damaged plants in spring, a mean rate of 12%."]


def test_defects(spark):
    q, e = "怎样区分甲虫和乙虫？", "How do I tell the beetle from the moth?"
    filler = [(f"f{i}", q if i % 2 else e, SENTENCES[i % 2] * 2 if i % 2 else SENTENCES[2] + " " + SENTENCES[3], "防治建议") for i in range(40)]
    rows = [
        ("null", q, None, ""), ("blank", q, "　​\n", ""), ("label", q, "答：", ""), ("none", q, "暂无", ""), ("marks", q, "——", ""),
        ("copy", q, "“怎样区分甲虫和乙虫？”", ""), ("copy2", e, "You asked: How do I tell the beetle from moth?", ""), ("restated", q, "怎样区分甲虫和乙虫——" + SENTENCES[0], ""),
        ("refusal", q, "抱歉，我无法回答这个问题。", ""), ("refusal2", e, "I'm sorry, but I cannot help with that.", ""), ("correction", q, "抱歉之前说法有误，更正如下：" + SENTENCES[1], ""),
        ("lacking", q, "所给片段没有涉及甲虫，证据不足，不能得出结论。", " 证据不足　"), ("lacking2", q, "所给片段没有涉及甲虫，证据不足，不能得出结论。", "防治建议"),
        ("foreign", q, SENTENCES[2], ""), ("foreign2", e, SENTENCES[0], ""), ("french", e, "Après la récolte, il faut brûler les résidus et arroser la parcelle.", ""), ("term", "甲虫的英文名称是什么？", "leaf beetle", ""),
        ("names", e, SENTENCES[3] + " Growers call it 甲虫（菜）.", ""), ("cut", q, "留种田若不清除残体，第二年的基数会成", ""), ("cut2", e, "Plants that collapse cannot recover and should be car", ""),
        ("omission", q, "已经倒伏的植株无法恢复，应带出…", ""), ("list", q, "要点如下：\n1. " + SENTENCES[0] + "\n2.", ""), ("nostop", q, SENTENCES[1][:-1], ""), ("nostop2", e, SENTENCES[2][:-1], ""),
        ("short", q, "是的", ""), ("short2", e, "In spring", ""), (None, q, None, ""), ("null", q, None, ""),
    ]
    got = pairs(spark, filler + rows)
    want = {
        **dict.fromkeys(("null", "blank", "label", "none", "marks"), "empty_answer"), **dict.fromkeys(("copy", "copy2"), "copied_question"),
        **dict.fromkeys(("refusal", "refusal2", "lacking2"), "refusal"), **dict.fromkeys(("foreign", "foreign2", "french"), "wrong_language"), **dict.fromkeys(("cut", "cut2", "omission", "list"), "truncated"),
    }
    assert got == want


def test_long_answers_are_judged_like_short_ones(spark):
    q = "怎样区分甲虫和乙虫？"
    no, said = "我无法回答这个问题。", SENTENCES[0]
    got = pairs(spark, [("long", q, no * 40, ""), ("more", q, no * 40 + said * 10, ""), ("once", q, no + said * 3, ""), ("lack", q, "所给片段没有涉及甲虫，证据不足。" * 20, "防治建议"), ("aside", q, said * 3 + "另一处证据不足。" + said * 3, "防治建议")])
    assert got == {"long": "refusal", "more": "refusal", "lack": "refusal"}


def test_evidence_of_truncation(spark):
    long = "留种田若不清除残体，第二年的基数会成倍增加，应及时深埋残体"
    full = [(f"f{i}", "怎样处理？", SENTENCES[i % 2] * 2, "t", T0) for i in range(30)]
    rows = [("twin", "怎样处理？", long[:22] + "……", "t", T0), ("whole", "怎样处理？", long + "。", "t", T0), ("open", "怎样处理？", "应在田外（低洼处集中处理病残体并深埋", "t", T0)]
    df = spark.createDataFrame(full + rows, "id string, question string, gold_answer string, task_type string, ingested_at timestamp_ntz")
    got = {r["id"]: set(r["evidence"]) for r in judged_pairs(df, "id", "question", "gold_answer", "task_type").collect()}
    assert set(got) == {"twin", "open"} and {"omission", "longer"} <= got["twin"] and "bracket" in got["open"]
    assert {r["evidence"] for r in evidence_report(judged_pairs(df, "id", "question", "gold_answer", "task_type")).collect()} >= {"omission", "longer", "bracket"}


def test_pairs_of_an_empty_table(spark):
    assert pairs(spark, []) == {}


def test_shortened_versions_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = sorted({"".join(rng.choice(list("ab"), rng.integers(1, 8))) for _ in range(120)})
    df = spark.createDataFrame([(t,) for t in texts], "text string").repartition(7)
    got = {r["text"] for r in joined_edges(shortened_versions(df)).collect()}
    assert got == {t for t in texts if any(o != t and o.startswith(t) for o in texts)}


def test_sentence_ends():
    m = SentenceEnds(SENTENCES * 5)
    assert m.finality("应带出田外集中处理") > 0.5 > m.finality("第二年的基数会成")
    assert 0 <= SentenceEnds([]).finality("x") <= 1


def test_sentence_ends_are_counted_over_all_answers(spark):
    rng = np.random.default_rng(8)
    texts = sorted({"".join(rng.choice(list("甲乙丙，。. a"), rng.integers(1, 60))) for _ in range(300)} | set(SENTENCES))
    asked = sorted({t[:i] for t in texts[::5] for i in (1, len(t) // 2, len(t)) if t[:i]} | {"", "丁", SENTENCES[1][:-1]})
    df = lambda ts: spark.createDataFrame([(t,) for t in ts], "text string").repartition(5)
    m, got = SentenceEnds(texts), {r["text"]: r["finality"] for r in finalities(df(texts * 2), df(asked)).collect()}
    assert set(got) == set(asked) and all(abs(got[t] - m.finality(re.sub(" +", " ", t).rstrip())) < 1e-9 for t in asked)


def test_verdicts_stay_in_a_larger_table(spark):
    q, other = "怎样区分甲虫和乙虫？", "乙丙丁戊己庚辛壬癸子丑寅卯辰巳午未申酉戌亥"
    clauses = ["田边杂草上聚集", "沟渠两侧多积水", "砧木伤口处愈合", "棚膜内壁挂露珠", "土块下面越寒冬", "蜜腺周围有蚂蚁", "幼果脐部先变黑", "叶背绒毛渐脱落"]
    rare = [(f"{x}{i}", q, f"{'春秋'[i]}季在当地的田里观察到{c}" + "。" * i, "") for x, c in enumerate(clauses) for i in (0, 1)]
    more = [(f"m{i}", q, "".join(other[(i // 21**k) % 21] for k in range(4)) * 5 + "。", "") for i in range(20_000)]
    assert pairs(spark, rare) == pairs(spark, rare + more) == {}


def test_every_length_limit_counts(spark):
    spikes = spark.range(1100).selectExpr("cast(50 + id * 10 as int) length").crossJoin(spark.range(20)).select("length")
    assert sorted(r["length"] for r in length_limits(spikes).collect()) == [50 + i * 10 for i in range(1100)]


def sampled(spark, a, targets):
    src = spark.createDataFrame(a, "id string, kind string, ingested_at timestamp_ntz, category string")
    t = spark.createDataFrame(targets, "target_id int, source_table string, kind string, target_permille int, min_rows int, sample_permille int")
    return sample_by_targets([Source("s", src, "id", ["kind"])], t)


def test_sampling(spark):
    rows = [(f"r{i}", " a　" if i % 3 else "b", T0, "clash") for i in range(300)] * 2 + [("n", None, T0, "x"), (None, "a", T0, "x")]
    targets = [(1, "s", "a", 500, 3, 400), (2, "s", "b", 900, 3, 400), (3, "s", "c", 5, 4, 400), (4, "other", "a", 5, 4, 400), (5, "s", "c", 0, 0, 400)]
    r = sampled(spark, rows, targets)
    report = {x["target_id"]: x.asDict() for x in r.report.collect()}
    assert report[1]["n_records"] == 301 and (report[1]["observed"], report[1]["quota"], report[1]["deficit"]) == (200, 60, 0)
    assert (report[2]["observed"], report[2]["quota"], report[2]["deficit"]) == (100, 108, 8) and report[3]["deficit"] == 4 and set(report) == {1, 2, 3, 5}
    got = [(x["target_id"], x["record_key"]) for x in r.sample.collect()]
    assert len(got) == len(set(got)) and [sum(t == k for t, _ in got) for k in (1, 2, 3)] == [60, 100, 0]
    assert {x["target_id"] for x in deficits(r.report).collect()} == {2, 3}
    assert sorted(got) == sorted((x["target_id"], x["record_key"]) for x in sampled(spark, rows, targets).sample.collect())


def test_the_report_counts_the_sample(spark, monkeypatch):
    drawn = []
    monkeypatch.setattr(sampling, "written", lambda df, label: drawn.append((label, written(df, label))) or drawn[-1][1])
    r = sampled(spark, [(f"r{i}", "a", T0, "x") for i in range(50)], [(1, "s", "a", 500, 3, 400), (2, "s", "b", 500, 3, 400)])
    samples = [d for label, d in drawn if label.endswith("-sample")]
    assert len(samples) == 1 and samples[0].count() == r.sample.count() == 10
    path = samples[0].inputFiles()[0].rpartition("/")[0]
    assert any(f.startswith(path) for f in r.report.inputFiles())
    assert sorted((x["target_id"], x["sampled"], x["deficit"]) for x in r.report.collect()) == [(1, 10, 0), (2, 0, 10)]


def test_too_few_acceptances_are_mended(spark, monkeypatch):
    rows = [(f"r{i}", "ab"[i % 2], T0, "x") for i in range(400)]
    targets = [(1, "s", "a", 250, 3, 1000), (2, "s", "b", 200, 3, 1000)]
    want = sorted((x["target_id"], x["record_key"]) for x in sampled(spark, rows, targets).sample.collect())
    drawn = {}
    monkeypatch.setattr(sampling, "MARGIN", (-3, 0))  # far too few are accepted
    monkeypatch.setattr(sampling, "written", lambda df, label: drawn.setdefault(label.rpartition("-")[2], written(df, label)))
    r = sampled(spark, rows, targets)
    assert sorted((x["target_id"], x["record_key"]) for x in r.sample.collect()) == want and len(want) == 180
    assert drawn["accepted"].count() < 150 and drawn["short"].count() == 2


def test_few_are_accepted_of_many(spark, monkeypatch):
    drawn = {}
    monkeypatch.setattr(sampling, "written", lambda df, label: drawn.setdefault(label.rpartition("-")[2], written(df, label)))
    r = sampled(spark, [(f"r{i}", "a", T0, "x") for i in range(5000)], [(1, "s", "a", 100, 3, 100)])
    assert r.sample.count() == 50 and 50 <= drawn["accepted"].count() < 250 and drawn["short"].count() == 0


def test_sampling_of_an_empty_table(spark):
    r = sampled(spark, [], [(1, "s", "a", 500, 3, 400)])
    assert r.sample.count() == 0 and r.report.first()["deficit"] == 3


ENTRIES = [(1, "k", ["虫害", "insect pest", "害虫"]), (2, "k", ["植物病害", "plant disease"]), (3, "k", ["发生时期", "occurrence window"]), (4, "other", ["虫害", "insect pests"])]


VALUES = {
    "insect pest": 1, "Insect_Pest": 1, "InsectPest": 1, "2) isnect pets": 1, "type: 害蟲": 1, "害 虫": 1, "isnetc pest": 1, "ｉｎｓｅｃｔ ｐｅｓｔ": 1, "植病害": 2, "plantdisease": 2,
    "discase of the moon": 0, "发生时期（occurrence window）": 3, "invoice": 0, "??": 0, "x" * 5000: 0,
}


def test_canonical(spark):
    v = spark.createDataFrame([("k", x) for x in [*VALUES, *VALUES, None, "　"]], "kind string, value string").selectExpr("*", "'clash' word", "1 canonical_id")
    e = spark.createDataFrame(ENTRIES, "canonical_id int, kind string, names array<string>")
    got = [(r["value"], r["canonical_id"]) for r in map_to_canonical(v, e).collect()]
    assert sorted(got) == sorted(VALUES.items())


def test_traditional_characters_of_any_word(spark):
    v = spark.createDataFrame([("k", x) for x in ("龜裂", "鐵銹鬱", "臺灣蟲害")], "kind string, value string")
    e = spark.createDataFrame([(1, "k", ["龟裂"]), (2, "k", ["铁锈郁"]), (3, "k", ["台湾虫害"])], "canonical_id int, kind string, names array<string>")
    assert {r["value"]: r["canonical_id"] for r in map_to_canonical(v, e).collect()} == {"龜裂": 1, "鐵銹鬱": 2, "臺灣蟲害": 3}


def test_a_rule_out_of_reach_is_no_result(spark, monkeypatch):
    v = spark.createDataFrame([("k", "龜裂")], "kind string, value string")
    e = spark.createDataFrame([(1, "k", ["龟裂"])], "canonical_id int, kind string, names array<string>")
    canonical._simplified.cache_clear()
    with monkeypatch.context() as m:  # the session is that of the values, whether or not one is active in this thread
        m.setattr(type(spark), "getActiveSession", classmethod(lambda cls: None))
        assert [r["canonical_id"] for r in map_to_canonical(v, e).collect()] == [1]
    canonical._simplified.cache_clear()
    with monkeypatch.context() as m:
        m.setattr(type(spark), "_jvm", property(lambda self: None), raising=False)
        with pytest.raises(RuntimeError, match="can't be reached"):
            canonical._simplified(spark)
    with monkeypatch.context() as m:
        m.setattr(canonical, "is_remote", lambda: True)
        with pytest.raises(RuntimeError, match="can't reach"):
            map_to_canonical(v, e)
    assert [r["canonical_id"] for r in map_to_canonical(v, e).collect()] == [1]  # a failure isn't kept


def test_canonical_of_empty_tables(spark):
    v = spark.createDataFrame([("k", "a")], "kind string, value string")
    e = spark.createDataFrame([], "canonical_id int, kind string, names array<string>")
    assert [r["canonical_id"] for r in map_to_canonical(v, e).collect()] == [0] and map_to_canonical(v.limit(0), e).count() == 0


def test_repair_against_all_pairs(spark):
    rng = np.random.default_rng(6)
    words = ["crop", "damages", "pathogen", "morphological", "=invoice", "期"]
    toks = sorted({"".join(rng.permutation(list(w)))[: rng.integers(1, 14)] if rng.random() < 0.2 else w[:i] + c + w[i + d :] for w in words for i in range(len(w)) for c in ("", "x") for d in (0, 1)} - {""})
    f = spark.createDataFrame([(t,) for t in toks], "token string")
    v = spark.createDataFrame([(w,) for w in words], "word string")
    got = {(r["token"], r["word"]) for r in repaired(f, v).collect()}
    k = {w: min(n - 1, 1 if n <= 5 else 2 if n <= 7 else int(n * 0.34)) for w in words for n in [len(w.lstrip("="))]}
    alike = lambda t, w: t.startswith("=") == w.startswith("=") and t.lstrip("=") and swap_distance(t.lstrip("="), w.lstrip("=")) <= k[w]
    assert got == {(t, w) for t in toks for w in words if alike(t, w)}


def test_repair_of_many_swaps(spark):
    want = {("omrhpoolgcial", "morphological"), ("omrhpoolgica", "morphological"), ("ba", "ab")}
    f = spark.createDataFrame([(t,) for t, _ in want], "token string")
    v = spark.createDataFrame([("morphological",), ("ab",)], "word string")
    assert all(swap_distance(t, w) <= 4 for t, w in want)
    assert {(r["token"], r["word"]) for r in repaired(f, v).collect()} == want
