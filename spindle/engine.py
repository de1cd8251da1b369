"""A facade over the operators: tables of a knowledge base, and queries in the known modes.

Steps that need models take functions; without one they raise. Everything returns DataFrames.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, functions as F

from spindle.functions.ontology import DEFAULT, Ontology
from spindle.functions.predicates import IMAGE_SUFFIXES, chunk_kind, within
from spindle.functions.text import chunk_ids, image_paths, suffix_of
from spindle.functions.udfs import balanced_object, content_key, vision_parts
from spindle.operators import blocks as B, cleanup as C, documents as D, graph as G, retrieval as R
from spindle.operators.records import latest_version, upsert
from spindle.resilience import Callbacks
from spindle.session import ship
from spindle.sources import files

MODES = ("local", "global", "hybrid", "mix", "naive", "bypass")
#: Heads that are kept (fixed values): sub-questions of a plan, characters of its context, of a preview and of a snippet, images cited where no chunk is.
SUB_QUESTIONS, PLAN_CHARS, PREVIEW, SNIPPET, CITED_IMAGES = 3, 12_000, 2_000, 320, 3


@dataclass(frozen=True)
class Config:
    """What may be set: windows, budgets and the ontology."""

    context_window: int = 1
    context_chars: int = 2000
    top_k: int = 10
    least_cosine: float = 0.2
    context_budget: int = 12_000
    merge_threshold: float = 0.86
    plan_chars: int = PLAN_CHARS
    safe_folders: tuple[str, ...] = ()
    ontology: Ontology = DEFAULT


@dataclass
class KnowledgeBase:
    """nodes, edges, chunks and vectors (item, kind, vec_id, embedding) of one or more knowledge bases."""

    nodes: DataFrame
    edges: DataFrame
    chunks: DataFrame
    vectors: DataFrame | None = None
    facts: DataFrame | None = None
    merged: DataFrame | None = None


@dataclass
class Engine:
    spark: SparkSession
    config: Config = field(default_factory=Config)
    callbacks: Callbacks = field(default_factory=Callbacks)
    parsers: dict[str, Callable[[DataFrame], DataFrame]] = field(default_factory=dict)
    embed: Callable[[list[str]], list[list[float]]] | None = None
    answer: Callable[[str, str], str] | None = None
    plan: Callable[[str], str] | None = None
    describe: Callable[[dict], str] | None = None
    look: Callable[[str, list[bytes]], str] | None = None
    arbiter: Callable[[str, list[dict]], str] | None = None
    cache: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        ship(self.spark)

    def update_config(self, **changes) -> Config:
        self.config = replace(self.config, **changes)
        return self.config

    def register_parser(self, suffix: str, parser: Callable[[DataFrame], DataFrame]) -> None:
        """A parser takes files (path, content) and gives blocks; suffixes are compared in lower case, content lists can't be replaced."""
        s = suffix.strip().lower()
        if not s or s == ".json":
            raise ValueError("no suffix" if not s else "content lists have their own reader")
        self.parsers[s if s.startswith(".") else "." + s] = parser

    def unregister_parser(self, suffix: str) -> bool:
        s = suffix.strip().lower()
        return self.parsers.pop(s if s.startswith(".") else "." + s, None) is not None

    def list_parsers(self) -> list[str]:
        return sorted([".json", *self.parsers])

    def processors(self) -> dict[str, bool]:
        """What the engine can do as it is configured."""
        return {k: getattr(self, k) is not None for k in ("embed", "answer", "plan", "describe", "look", "arbiter")} | {"parsers": bool(self.parsers)}

    def parse_folder(self, path: str) -> DataFrame:
        """Blocks of all files that a registered parser reads, as one table."""
        raw = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
        out = None
        for s, parser in self.parsers.items():
            part = parser(raw.filter(suffix_of(F.col("path")) == s))
            out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        if out is None:
            raise ValueError("no parser is registered")
        self.callbacks.send("parsed", path=path)
        return out

    def read_blocks(self, path: str, base: str = "") -> DataFrame:
        return files.read_content_lists(self.spark, path, base)

    def insert(self, blocks: DataFrame, chunks: DataFrame | None = None) -> DataFrame:
        """Chunks of the blocks that aren't noise; with those given, the later one of each id."""
        made = B.multimodal_chunks(B.filter_blocks(blocks, self.config.ontology)).withColumn("version", F.current_timestamp())
        return made.drop("version") if chunks is None else upsert(chunks, made, "chunk_id", order="version").drop("version")

    def contexts(self, blocks: DataFrame) -> DataFrame:
        return B.page_context(blocks, self.config.context_window, most=self.config.context_chars)

    def clean(self, kb: KnowledgeBase) -> KnowledgeBase:
        """The graph with names normalised, alike ones merged, relations mapped, attributes as facts and noise types left out."""
        lacking = {"file_path": "string", "attributes": "map<string,string>", "created_at": "timestamp"}
        fill = lambda df: df.withColumns({c: F.lit(None).cast(t) for c, t in lacking.items() if c not in df.columns})
        g, counts = C.clean_graph(fill(kb.nodes), fill(kb.edges), self.config.merge_threshold, self.arbiter, self.config.ontology)
        return replace(kb, nodes=g.nodes, edges=g.edges, facts=g.facts, merged=counts)

    def vectors_of(self, items: DataFrame, text: str, key: str) -> DataFrame:
        """vec_id and embedding of items by the embedding function, in batches."""
        if self.embed is None:
            raise ValueError("no embedding function is given")
        import pandas as pd

        embed = self.embed

        def run(frames):
            for f in frames:
                yield pd.DataFrame({"vec_id": f[key], "embedding": embed(f[text].fillna("").tolist())})

        return items.select(key, text).mapInPandas(run, f"vec_id {items.schema[key].dataType.simpleString()}, embedding array<float>")

    def retrieve(self, kb: KnowledgeBase, queries: DataFrame, mode: str = "mix") -> DataFrame:
        """query_id, chunk_id, rank: chunks for queries (query_id, embedding) within the budget of the context.

        vectors of kb hold kind (entity, relation or chunk), item (node_id, edge_id or chunk_id as text).
        """
        if mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")
        if kb.vectors is None or mode == "bypass":
            return self.spark.createDataFrame([], "query_id long, chunk_id string, rank int")
        hits = lambda kind: self._hits(kb, queries, kind)
        lists = []
        if mode in ("local", "hybrid", "mix"):
            named = hits("entity").join(kb.nodes.select(F.col("node_id").cast("string").alias("item"), G.keys_of("source_ids").alias("source_ids")), "item")
            lists.append(R.by_weight(named))
        if mode in ("global", "hybrid", "mix"):
            named = hits("relation").join(kb.edges.select(F.col("edge_id").cast("string").alias("item"), G.keys_of("source_ids").alias("source_ids")), "item")
            lists.append(R.by_weight(named))
        if mode in ("naive", "mix"):
            lists.append(hits("chunk").select("query_id", F.col("item").alias("chunk_id"), "rank"))
        merged = R.round_robin(lists, "chunk_id").withColumnRenamed("position", "rank")
        told = merged.join(latest_version(kb.chunks, "chunk_id").select("chunk_id", "content"), "chunk_id")
        return R.within_budget(told, "query_id", "rank", "content", self.config.context_budget)

    def _hits(self, kb: KnowledgeBase, queries: DataFrame, kind: str) -> DataFrame:
        index = kb.vectors.filter(F.col("kind") == kind)
        near = R.vector_top_k(queries, index.select("vec_id", "embedding"), self.config.top_k, self.config.least_cosine)
        return near.join(index.select("vec_id", "item"), "vec_id")

    def context(self, kb: KnowledgeBase, queries: DataFrame, mode: str = "mix") -> DataFrame:
        """query_id and context: what is told of entities, of relations and of chunks, one part after another; parts without rows are left out.

        Entities and relations come by rank, chunks within the budget. bypass has no context.
        """
        if kb.vectors is None or mode == "bypass":
            return queries.select("query_id", F.lit("").alias("context"))
        line = lambda *c: F.concat_ws(" | ", *[F.coalesce(F.col(x).cast("string"), F.lit("")) for x in c])
        parts = []
        if mode in ("local", "hybrid", "mix"):
            n = kb.nodes.select(F.col("node_id").cast("string").alias("item"), "id", "entity_type", "description")
            parts.append(self._hits(kb, queries, "entity").join(n, "item").select("query_id", F.lit(1).alias("part"), "rank", line("id", "entity_type", "description").alias("line")))
        if mode in ("global", "hybrid", "mix"):
            e = kb.edges.select(F.col("edge_id").cast("string").alias("item"), "source", "target", "relation_type", "description")
            parts.append(self._hits(kb, queries, "relation").join(e, "item").select("query_id", F.lit(2).alias("part"), "rank", line("source", "relation_type", "target", "description").alias("line")))
        parts.append(self.retrieve(kb, queries, mode).select("query_id", F.lit(3).alias("part"), "rank", F.concat(F.lit("["), "chunk_id", F.lit("] "), "content").alias("line")))
        rows = parts[0]
        for p in parts[1:]:
            rows = rows.unionByName(p)
        rows = rows.groupBy("query_id", "part").agg(F.array_join(F.array_sort(F.collect_list(F.struct("rank", "line")))["line"], "\n").alias("text"))
        head = F.element_at(F.array(F.lit("Entities"), F.lit("Relationships"), F.lit("Chunks")), F.col("part"))
        text = F.array_join(F.array_sort(F.collect_list(F.struct("part", F.concat(head, F.lit(":\n"), "text").alias("t"))))["t"], "\n\n")
        return queries.select("query_id").join(rows.groupBy("query_id").agg(text.alias("context")), "query_id", "left").withColumn("context", F.coalesce("context", F.lit("")))

    def _one(self, text: str) -> DataFrame:
        if self.embed is None:
            raise ValueError("an embedding function is needed")
        return self.spark.createDataFrame([(-1, [float(x) for x in self.embed([text])[0]])], "query_id long, embedding array<float>")

    def fetch_context(self, kb: KnowledgeBase, text: str, mode: str = "mix") -> str:
        """The context of one question, without an answer."""
        return "" if mode == "bypass" else self.context(kb, self._one(text), mode).first()["context"]

    def query(self, kb: KnowledgeBase, text: str, mode: str = "mix") -> tuple[str, DataFrame]:
        """The answer to one question, and the chunks it rests on. Listeners hear of its start and end, or of the error that ended it."""
        if self.answer is None or (self.embed is None and mode != "bypass"):
            raise ValueError("an answer and an embedding function are needed")
        self.callbacks.send("query_start", text=text, mode=mode)
        try:
            if mode == "bypass":
                found, context = self.spark.createDataFrame([], "query_id long, chunk_id string, rank int"), ""
            else:
                found = self.retrieve(kb, self._one(text), mode)
                # as many rows as the budget of the context allows
                context = "\n\n".join(r["content"] for r in found.orderBy("rank").collect())
            out = self.answer(text, context)
        except Exception as x:
            self.callbacks.send("query_error", text=text, mode=mode, error=str(x))
            raise
        self.callbacks.send("query_end", text=text, mode=mode)
        return out, found

    def planned(self, text: str) -> list[str]:
        """At most three sub-questions by the planner; the question itself where there is none, or its plan can't be read."""
        try:
            found = json.loads(balanced_object(self.plan(text)) or "{}").get("sub_questions", []) if self.plan else []
            subs = [str(x).strip() for x in found if str(x).strip()][:SUB_QUESTIONS]
        except Exception:  # noqa: BLE001
            subs = []
        return subs or [text]

    def query_planned(self, kb: KnowledgeBase, text: str, mode: str = "hybrid") -> dict:
        """An answer by way of a plan: the context is fetched once, for the question itself; sub-questions only guide the answer."""
        if self.answer is None:
            raise ValueError("an answer function is needed")
        subs, context = self.planned(text), self.fetch_context(kb, text, mode)[: self.config.plan_chars]
        asked = text if subs == [text] else "\n".join([text, *(f"- {s}" for s in subs)])
        return {"answer": self.answer(asked, context), "sub_questions": subs, "context": context[:PREVIEW]}

    def query_multimodal(self, kb: KnowledgeBase, text: str, content: list[dict], mode: str = "mix", **options) -> str:
        """An answer to a question with content: each item is described, and the descriptions join the question. The same content is answered from the cache."""
        key = content_key(text, mode, json.dumps(content, ensure_ascii=False), json.dumps(options))
        if key not in self.cache:
            told = []
            for item in content:
                said = self.describe(item) if self.describe else str(item.get("text") or item.get("table_body") or item.get("img_path") or "")
                told.append(f"[{item.get('type', 'item')}] {said}")
            self.cache[key] = self.query(kb, "\n\n".join([text, *told]), mode)[0]
        return self.cache[key]

    def query_vision(self, kb: KnowledgeBase, text: str, images: DataFrame, mode: str = "mix") -> str:
        """An answer by a model that sees the images whose paths the context names; images has path and content.

        Only images in safe folders, of known suffix and size, are shown; without any, text alone is asked.
        """
        if self.look is None:
            return self.query(kb, text, mode)[0]
        context = self.fetch_context(kb, text, mode)
        told = self.spark.createDataFrame([(context,)], "t string").select(F.explode(image_paths(F.col("t"))).alias("path"))
        good = within(F.col("path"), list(self.config.safe_folders)) & suffix_of(F.col("path")).isin(*IMAGE_SUFFIXES) & (F.length("content") <= 50 * 1024 * 1024)
        # no more images than the context names
        seen = {r["path"]: r["content"] for r in told.join(images, "path").filter(good).collect()}
        prompt, used = vision_parts(context, {p: p for p in seen})
        return self.look(f"{prompt}\n\n{text}", [bytes(seen[p]) for p in used]) if used else self.query(kb, text, mode)[0]

    def citations(self, kb: KnowledgeBase, context: str) -> DataFrame:
        """position, chunk_id, file_path, page_idx, snippet, modality and image_path of the chunks that a context names; where it names none, of its first images."""
        one = self.spark.createDataFrame([(context,)], "t string")
        ids = one.select(F.posexplode(chunk_ids(F.col("t"))).alias("position", "chunk_id"))
        told = latest_version(kb.chunks, "chunk_id").withColumn("k", chunk_kind(F.col("content")))
        have = set(told.columns)
        told = told.select("chunk_id", *[F.col(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in (("file_path", "string"), ("page_idx", "int"))], F.substring(F.trim(F.regexp_replace("content", r"(?U)\s+", " ")), 1, SNIPPET).alias("snippet"), "k.modality", "k.image_path")
        cited = ids.join(told, "chunk_id", "left").withColumn("page_idx", F.coalesce("page_idx", F.lit(-1))).select("position", "chunk_id", "file_path", "page_idx", "snippet", "modality", "image_path")
        shown = one.filter(F.size(chunk_ids(F.col("t"))) == 0).select(F.posexplode(F.slice(image_paths(F.col("t")), 1, CITED_IMAGES)).alias("position", "image_path"))
        blank = {"chunk_id": "string", "file_path": "string", "snippet": "string"}
        shown = shown.withColumns({c: F.lit("").cast(t) for c, t in blank.items()}).withColumn("page_idx", F.lit(-1)).withColumn("modality", F.lit("image"))
        return cited.unionByName(shown)

    def ask(self, kb: KnowledgeBase, text: str, mode: str = "hybrid", planned: bool = True) -> dict:
        """An answer with its citations and the seconds each stage took; what goes wrong with the evidence doesn't lose the answer."""
        took: dict[str, float] = {}

        def timed(stage: str, f: Callable):
            began = time.perf_counter()
            try:
                return f()
            finally:
                took[stage] = round(time.perf_counter() - began, 4)

        if planned:
            out = timed("answer", lambda: self.query_planned(kb, text, mode))
        else:
            out = {"answer": timed("answer", lambda: self.query(kb, text, mode)[0]), "sub_questions": [text]}
        try:
            context = timed("context", lambda: self.fetch_context(kb, text, mode))
            out["citations"] = timed("citations", lambda: [r.asDict() for r in self.citations(kb, context).orderBy("position").collect()])
        except Exception as x:  # noqa: BLE001
            out |= {"citations": [], "evidence_error": str(x)}
        return out | {"timings": took | {"total": round(sum(took.values()), 4)}}

    @staticmethod
    def ablated(mode: str, graph: bool = True, retrieval: bool = True) -> str:
        """The mode that is left without retrieval, or without the graph."""
        return "bypass" if not retrieval else "naive" if not graph else mode

    def status(self, documents: DataFrame, status: DataFrame) -> DataFrame:
        return D.document_statuses(documents, status)
