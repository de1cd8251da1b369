import pytest
from pyspark.sql import functions as F

from spindle.engine import Config, Engine, KnowledgeBase
from spindle.resilience import Callbacks, CircuitBreaker, CircuitOpen, pause, retry


def test_retry():
    calls, slept = [], []

    @retry(3, 1.0, 2.0, 60.0, sleep=slept.append, chance=lambda: 0.0)
    def fails():
        calls.append(1)
        raise ConnectionError

    with pytest.raises(ConnectionError):
        fails()
    assert len(calls) == 3 and slept == [1.0, 2.0] and pause(10, 1, 2, 60) == 60

    @retry(3, sleep=slept.append)
    def wrong():
        calls.append(1)
        raise ValueError

    with pytest.raises(ValueError):
        wrong()
    assert len(calls) == 4


def test_breaker():
    now = [0.0]
    b = CircuitBreaker(2, 10, 60, lambda: now[0])

    def bad():
        raise RuntimeError

    for _ in range(2):
        with pytest.raises(RuntimeError):
            b.call(bad)
    with pytest.raises(CircuitOpen):
        b.call(lambda: 1)
    now[0] = 11
    assert b.call(lambda: 1) == 1 and b.state == "closed"


def test_callbacks():
    seen, c = [], Callbacks()
    c.add(lambda e, d: 1 / 0)
    c.add(lambda e, d: seen.append((e, d)))
    assert c.send("x", a=1) == 1 and seen == [("x", {"a": 1})]


def test_engine(spark):
    e = Engine(spark, embed=lambda texts: [[1.0, 0.0] if "a" in t else [0.0, 1.0] for t in texts], answer=lambda q, c: f"{q}: {c}")
    n = spark.createDataFrame([(1, "k", "甲蚜虫", "虫害", "", ["c1"])], "node_id long, kb_id string, id string, entity_type string, description string, source_ids array<string>")
    g = spark.createDataFrame([(2, "k", "甲蚜虫", "乙", "damage", "", ["c2"], 1.0)], "edge_id long, kb_id string, source string, target string, relation_type string, description string, source_ids array<string>, weight double")
    c = spark.createDataFrame([("c1", "one", 1), ("c2", "two", 1), ("c3", "three", 1)], "chunk_id string, content string, ingested_at int")
    v = spark.createDataFrame([(1, "entity", "1", [1.0, 0.0]), (2, "relation", "2", [1.0, 0.1]), (3, "chunk", "c3", [1.0, 0.2]), (4, "chunk", "c1", [0.0, 1.0])], "vec_id long, kind string, item string, embedding array<float>")
    kb = KnowledgeBase(n, g, c, v)
    q = spark.createDataFrame([(-1, [1.0, 0.0])], "query_id long, embedding array<float>")
    got = {m: {r["chunk_id"] for r in e.retrieve(kb, q, m).collect()} for m in ("local", "global", "hybrid", "mix", "naive", "bypass")}
    assert got == {"local": {"c1"}, "global": {"c2"}, "hybrid": {"c1", "c2"}, "mix": {"c1", "c2", "c3"}, "naive": {"c3"}, "bypass": set()}
    answer, used = e.query(kb, "a?", "naive")
    assert answer == "a?: three" and used.count() == 1
    with pytest.raises(ValueError):
        e.retrieve(kb, q, "other")
    assert e.update_config(top_k=3) == Config(top_k=3)
    assert e.vectors_of(c, "content", "chunk_id").count() == 3
    assert {r["name"] for r in e.clean(kb).nodes.collect()} == {"甲蚜虫"}


def test_parsers(spark, tmp_path):
    (tmp_path / "a.TXT").write_text("x\n\ny")
    e = Engine(spark)
    with pytest.raises(ValueError):
        e.parse_folder(str(tmp_path))
    with pytest.raises(ValueError):
        e.register_parser(" ", None)
    e.register_parser("txt", lambda f: f.select(F.col("path").alias("file_path"), F.posexplode(F.split(F.decode("content", "UTF-8"), "\n\n")).alias("block_idx", "text")).withColumn("type", F.lit("text")))
    assert [r["text"] for r in e.parse_folder(str(tmp_path)).orderBy("block_idx").collect()] == ["x", "y"]
