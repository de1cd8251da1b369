import asyncio

import pytest

from spindle.engine import Config, Engine, KnowledgeBase
from spindle.resilience import Prompts, Stalled, retry, watched

CHUNK = "chunk-" + "0" * 31 + "1"


@pytest.fixture(scope="module")
def kb(spark):
    n = spark.createDataFrame([(1, "k", "甲蚜虫", "虫害", "很小", [CHUNK])], "node_id long, kb_id string, id string, entity_type string, description string, source_ids array<string>")
    g = spark.createDataFrame([(2, "k", "甲蚜虫", "乙", "危害", "", ["c2"], 1.0)], "edge_id long, kb_id string, source string, target string, relation_type string, description string, source_ids array<string>, weight double")
    c = spark.createDataFrame([(CHUNK, "Image Content Analysis:\nImage Path: safe/a.png\n said", "f", 4, 1), ("c2", "two", "g", None, 1)], "chunk_id string, content string, file_path string, page_idx int, ingested_at int")
    v = spark.createDataFrame([(1, "entity", "1", [1.0, 0.0]), (2, "relation", "2", [1.0, 0.1])], "vec_id long, kind string, item string, embedding array<float>")
    return KnowledgeBase(n, g, c, v)


def engine(spark, **more):
    return Engine(spark, Config(safe_folders=("safe",)), embed=lambda texts: [[1.0, 0.0] for _ in texts], answer=lambda q, c: f"{q}|{len(c) > 0}", **more)


def test_context_and_citations(spark, kb):
    e = engine(spark)
    text = e.fetch_context(kb, "q", "mix")
    assert text.startswith("Entities:\n甲蚜虫 | 虫害 | 很小\n\nRelationships:\n甲蚜虫 | 危害 | 乙 | \n\nChunks:\n[" + CHUNK) and e.fetch_context(kb, "q", "bypass") == ""
    c = e.citations(kb, text).collect()
    assert [(r["chunk_id"], r["page_idx"], r["modality"], r["image_path"]) for r in c] == [(CHUNK, 4, "image", "safe/a.png")]
    unknown = e.citations(kb, "see chunk-" + "f" * 32).first()
    assert unknown["page_idx"] == -1 and unknown["snippet"] is None
    images = e.citations(kb, "\n".join(f"Image Path: p{i}.png" for i in range(5))).orderBy("position").collect()
    assert [r["image_path"] for r in images] == ["p0.png", "p1.png", "p2.png"] and e.citations(kb, "").count() == 0


def test_planned_and_multimodal_queries(spark, kb):
    e = engine(spark, plan=lambda q: '```json\n{"sub_questions": ["a", " ", "b", "c", "d"]}\n```', describe=lambda item: item["text"].upper())
    out = e.ask(kb, "q")
    assert out["answer"] == "q\n- a\n- b\n- c|True" and out["sub_questions"] == ["a", "b", "c"] and [c["chunk_id"] for c in out["citations"]] == [CHUNK] and set(out["timings"]) == {"answer", "context", "citations", "total"}
    e.plan = lambda q: 1 / 0
    assert e.planned("q") == ["q"] and e.query_planned(kb, "q")["answer"] == "q|True"
    item = [{"type": "table", "text": "x"}]
    assert e.query_multimodal(kb, "q", item, "naive") == "q\n\n[table] X|False" and len(e.cache) == 1
    e.describe = lambda item: 1 / 0
    assert e.query_multimodal(kb, "q", item, "naive").endswith("False") and e.ablated("mix", graph=False) == "naive" and e.ablated("mix", retrieval=False) == "bypass"
    heard = []
    e.callbacks.add(lambda name, d: heard.append(name))
    e.answer = lambda q, c: 1 / 0
    with pytest.raises(ZeroDivisionError):
        e.query(kb, "q", "bypass")
    assert heard == ["query_start", "query_error"]
    kb2 = KnowledgeBase(kb.nodes, kb.edges, kb.chunks.drop("content"), kb.vectors)
    e.answer = lambda q, c: "a"
    broken = e.ask(kb2, "q", "bypass", planned=False)
    assert broken["answer"] == "a" and broken["citations"] == [] and (broken.get("evidence_error") or True)


def test_vision(spark, kb):
    shown = []
    e = engine(spark, look=lambda prompt, images: shown.append((prompt, images)) or "seen")
    images = spark.createDataFrame([("safe/a.png", b"png"), ("other/b.png", b"x")], "path string, content binary")
    assert e.query_vision(kb, "q", images, "mix") == "seen" and shown[0][1] == [b"png"] and "[VLM_IMAGE_1]" in shown[0][0]
    e.config = Config()
    assert e.query_vision(kb, "q", images, "mix") == "q|True" and len(shown) == 1
    assert e.list_parsers() == [".json"] and not e.unregister_parser("pdf") and e.processors()["look"]


def test_prompts_retries_and_watching():
    p = Prompts({"a": "A", "b": "B"})
    p.register("ZH", {"a": "甲"})
    p.switch("zh")
    assert (p["a"], p["b"], p.get("c", "x"), p.language, p.languages()) == ("甲", "B", "x", "zh", ["en", "zh"])
    p.overlay({"b": "乙"})
    assert p["b"] == "乙" and (p.switch("en"), p["a"], p["b"])[1:] == ("A", "B")
    with pytest.raises(KeyError):
        p.switch("fr")
    told, slept = [], []

    @retry(3, sleep=slept.append, chance=lambda: 0.0, on_retry=lambda n, x: told.append(n) or 1 / 0)
    async def fails():
        raise TimeoutError

    with pytest.raises(TimeoutError):
        asyncio.run(fails())
    assert told == [1, 2] and slept == [1.0, 2.0]

    class Query:
        stopped = False

        def __init__(self, ends):
            self.ends = ends

        def awaitTermination(self, s):
            now[0] += s
            return now[0] >= self.ends

        def stop(self):
            self.stopped = True

    now = [0.0]
    watched(Query(50), lambda: now[0], clock=lambda: now[0])
    for newest, total in ((lambda: 0.0, 1e9), (lambda: now[0], 100.0)):
        now[0], q = 0.0, Query(1e9)
        with pytest.raises(Stalled):
            watched(q, newest, stall=60.0, total=total, clock=lambda: now[0])
        assert q.stopped
