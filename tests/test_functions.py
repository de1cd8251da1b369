import difflib

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from spindle.functions import text as X
from spindle.functions.ontology import DEFAULT
from spindle.functions.udfs import balanced_object, ratio, robust_object


def one(spark, column, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return df.select(column.alias("x")).first()[0]


@pytest.mark.parametrize("given_, want", [("  a　b\n c ", "a b c"), (None, ""), ("　", "")])
def test_squeeze(spark, given_, want):
    assert one(spark, X.squeeze(F.col("v").cast("string")), v=given_) == want


@pytest.mark.parametrize("name, base, stage", [("菜粉蝶成虫", "菜粉蝶", "成虫"), ("菜粉蝶（低龄幼虫）", "菜粉蝶", "低龄幼虫"), ("菜粉蝶 3龄幼虫", "菜粉蝶", "3龄幼虫"), ("菜粉蝶", "菜粉蝶", ""), ("卵", "卵", "")])
def test_stages(spark, name, base, stage):
    got = one(spark, X.stage_parts(F.col("v")), v=name)
    assert (got["base"], got["stage"]) == (base, stage)


@pytest.mark.parametrize("name, kind, want", [("心叶", "作物", "部位"), ("十字花科", "作物", "生物分类"), ("aphid", "虫害", "其他"), ("蚜虫", "虫害", "虫害"), ("图1", "image", "多模态元素"), ("蚜虫", "nonsense", "其他")])
def test_types(spark, name, kind, want):
    assert one(spark, X.consistent_type(F.col("n"), F.col("k")), n=name, k=kind) == want


@pytest.mark.parametrize("words, want", [("part_of", "属类隶属"), ("pathogen of", "致病"), ("growth stage", "发生于"), ("stage", "生命周期"), ("省", "地理位置"), ("other", "")])
def test_relations(spark, words, want):
    assert one(spark, X.relation_of(F.col("v"), F.lit(None).cast("string")), v=words) == want


def test_allowed_pairs(spark):
    ok = lambda *a: one(spark, X.relation_allowed(*[F.lit(x) for x in a]), v=1)
    assert ok("致病", "病原菌", "病害") and not ok("致病", "作物", "病害") and ok("致病", "", "病害") and ok("属类隶属", "a", "b") and not ok("", "a", "b") and ok("地理位置", "作物", "时间")


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab中", max_size=6), min_size=2, max_size=2))
def test_bigram_cosine(spark, pair):
    grams = [[t[i : i + 2] for i in range(len(t) - 1)] or list(t) for t in pair]
    count = [{g: gs.count(g) for g in gs} for gs in grams]
    norm = [sum(v * v for v in c.values()) ** 0.5 for c in count]
    want = sum(v * count[1].get(g, 0) for g, v in count[0].items()) / (norm[0] * norm[1]) if all(norm) else 0
    assert one(spark, X.bigram_cosine(F.col("a"), F.col("b")), a=pair[0], b=pair[1]) == pytest.approx(want)


@pytest.mark.parametrize("text, most", [("short", 10), ("one. two three", 5), ("abcdefgh\nij", 10), ("abcdefghijkl", 5)])
def test_truncated(spark, text, most):
    head = text[:most]
    if len(text) <= most:
        want = text
    elif head.rfind(".") > len(head) * 0.8:
        want = head[: head.rfind(".") + 1]
    elif head.rfind("\n") > len(head) * 0.8:
        want = head[: head.rfind("\n")]
    else:
        want = head + "..."
    assert one(spark, X.truncated(F.col("v"), most), v=text) == want


def test_sentences_and_keys(spark):
    assert one(spark, X.sentences(F.col("v")), v="甲。乙！ 丙\n\n丁") == ["甲。", "乙！", "丙", "丁"]
    assert one(spark, X.split_keys(F.col("v")), v="a<SEP> b <SEP>a<SEP>") == ["a", "b"]
    assert one(spark, X.split_keys_loose(F.col("v")), v="a&lt;SEP&gt;b; c,d") == ["a", "b", "c", "d"]
    assert one(spark, X.safe_int(F.col("v")), v="1.0") == 0 and one(spark, X.safe_int(F.col("v")), v=" -7 ") == -7


def test_ratio_is_not_symmetric():
    assert ratio("tide", "diet") == difflib.SequenceMatcher(None, "tide", "diet").ratio() != ratio("diet", "tide")


@pytest.mark.parametrize("text, want", [('x {"a": 1} y', '{"a": 1}'), ("```json\n{\"a\": {}}\n```", '{"a": {}}'), ("{broken", None), (None, None), ("", None)])
def test_balanced(text, want):
    assert balanced_object(text) == want


@pytest.mark.parametrize("text", ['<think>no {</think>{"entity_name": "x",}', "```json\n{'entity_name': 'x'}\n```", 'text "entity_name": "x" text'])
def test_robust(text):
    assert '"entity_name": "x"' in robust_object(text)


def test_profile():
    assert len(DEFAULT.entity_types) == 19 and len(DEFAULT.relations) == 8 and all(len(p) == 3 for p in DEFAULT.pairs)
