"""Retrieval: vector search, graph expansion, merging of ranked lists, budgets and citations."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from spindle.functions.text import chunk_ids


#: Bytes of the vectors of queries that are sent to all tasks at once; more of them are held against the index block by block.
SENT = 64 << 20


def vector_top_k(queries: DataFrame, index: DataFrame, k: int = 10, least: float = 0.2, exclude_own: bool = False) -> DataFrame:
    """query_id, vec_id, score, rank: for each query (query_id, embedding) the k nearest rows of index (vec_id, embedding) by cosine.

    The stated queries are held against the whole index: as many as make SENT bytes are sent to every
    part of it, where a matrix product scores them and each part keeps its k best, which is what the
    final ranking sees. Their number is counted first; with more of them the index is met by one
    block of queries after another, as one union. Zero and null vectors match nothing; vectors of
    another length than the first query's match none of the queries. Ties go to the smaller id.
    exclude_own leaves out the row whose id is the query's, for queries taken from the index itself.
    """
    kind, vec = queries.schema["query_id"].dataType.simpleString(), index.schema["vec_id"].dataType.simpleString()
    q = queries.select("query_id", "embedding").filter(F.col("embedding").isNotNull() & F.col("query_id").isNotNull())
    n, longest = q.agg(F.count(F.lit(1)), F.max(F.size("embedding"))).first()
    blocks = max(1, -(-n * 8 * max(1, longest or 0) // SENT))
    schema = f"query_id {kind}, vec_id {vec}, score double"
    spark, out = queries.sparkSession, None
    for b in range(blocks):
        rows = q.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas() if blocks > 1 else q.toPandas()
        width = len(rows["embedding"].iloc[0]) if len(rows) else 0
        rows = rows[[len(e) == width and width > 0 for e in rows["embedding"]]] if len(rows) else rows
        m = np.array(rows["embedding"].tolist(), np.float64).reshape(len(rows), width)
        norm = np.linalg.norm(m, axis=1) if len(rows) else np.empty(0)
        shared = spark.sparkContext.broadcast((rows["query_id"].to_numpy()[norm > 0], m[norm > 0] / norm[norm > 0, None]))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, width=width) -> Iterator[pa.RecordBatch]:
            ids, m = shared.value
            for batch in batches:
                lists = batch.column(1)
                size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
                use = np.flatnonzero((size == width) & (width > 0))
                if not len(use) or not len(ids):
                    continue
                v = lists.take(pa.array(use)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
                norm = np.linalg.norm(v, axis=1)
                s = m @ (v / np.where(norm > 0, norm, 1)[:, None]).T
                keys = batch.column(0).take(pa.array(use))
                plain = keys.to_numpy(zero_copy_only=False)
                s[:, ~(norm > 0)] = -2
                if exclude_own:
                    s[ids[:, None] == plain[None, :]] = -2
                # the k best and their ties
                cut = -np.partition(-s, k - 1, axis=1)[:, k - 1] if s.shape[1] > k else np.full(len(s), -2.0)
                r, c = np.nonzero(s >= np.maximum(cut, least)[:, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[r]), keys.take(pa.array(c)), pa.array(s[r, c])], ["query_id", "vec_id", "score"])

        part = index.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull()).mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return out.withColumn("rank", r).filter(F.col("rank") <= k).select("query_id", "vec_id", "score", "rank")


def local_context(hits: DataFrame, edges: DataFrame, most_edges: int | None = None) -> DataFrame:
    """query_id, edge_id, rank: edges at the entities hit (query_id, kb_id, name, rank), by rank of the entity, then weight; all unless most_edges is given."""
    ends = edges.select("kb_id", F.col("source").alias("name"), "edge_id", "weight").unionByName(edges.select("kb_id", F.col("target").alias("name"), "edge_id", "weight"))
    near = hits.join(ends, ["kb_id", "name"]).groupBy("query_id", "edge_id").agg(F.min("rank").alias("hit"), F.max("weight").alias("weight"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("hit", F.desc("weight"), "edge_id"))
    near = near.withColumn("rank", r)
    return (near if most_edges is None else near.filter(F.col("rank") <= most_edges)).select("query_id", "edge_id", "rank")


def global_context(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """query_id, kb_id, name, rank: the ends of the edges hit (query_id, edge_id, rank), each once at its best rank."""
    e = hits.join(edges.select("edge_id", "kb_id", "source", "target"), "edge_id")
    both = e.select("query_id", "kb_id", F.col("source").alias("name"), "rank").unionByName(e.select("query_id", "kb_id", F.col("target").alias("name"), "rank"))
    return both.groupBy("query_id", "kb_id", "name").agg(F.min("rank").alias("rank"))


def round_robin(lists: list[DataFrame], item: str) -> DataFrame:
    """query_id, item, position: ranked lists (query_id, item, rank) merged in turn, each item at its first place."""
    tagged = None
    for i, part in enumerate(lists):
        p = part.select("query_id", item, "rank", F.lit(i).alias("source"))
        tagged = p if tagged is None else tagged.unionByName(p)
    first = tagged.groupBy("query_id", item).agg(F.min(F.struct("rank", "source")).alias("at"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy("at.rank", "at.source", item))
    return first.select("query_id", item, r.alias("position"))


def by_weight(hits: DataFrame, keys: str = "source_ids", most: int | None = None) -> DataFrame:
    """query_id, chunk_id, n, rank: chunks named by what was hit, the most often named first; all unless most is given."""
    counted = hits.withColumn("chunk_id", F.explode(keys)).groupBy("query_id", "chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("best"))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("n"), "best", "chunk_id"))
    counted = counted.withColumn("rank", r)
    return (counted if most is None else counted.filter(F.col("rank") <= most)).select("query_id", "chunk_id", "n", "rank")


def by_vector(hits: DataFrame, queries: DataFrame, vectors: DataFrame, keys: str = "source_ids", most: int | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank: chunks named by what was hit (query_id, keys), those nearest to the query first.

    queries has query_id and embedding, vectors chunk_id and embedding. Chunks without a vector, or with that of zero, are left out.
    """
    named = hits.select("query_id", F.explode(keys).alias("chunk_id")).distinct()
    pairs = named.join(vectors.select("chunk_id", F.col("embedding").alias("v")), "chunk_id").join(queries.select("query_id", F.col("embedding").alias("q")), "query_id")
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    score = dot("q", "v") / F.nullif(F.sqrt(dot("q", "q") * dot("v", "v")), F.lit(0.0))
    r = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "chunk_id"))
    ranked = pairs.withColumn("score", score).filter(F.col("score").isNotNull()).withColumn("rank", r)
    return (ranked if most is None else ranked.filter(F.col("rank") <= most)).select("query_id", "chunk_id", "score", "rank")


def within_budget(pieces: DataFrame, by: str, order: str, text: str, budget: int) -> DataFrame:
    """Pieces in order until budget characters are used up; the last one is cut, the rest left out."""
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length(text)).over(w), F.lit(0))
    return pieces.withColumn("used", used).filter(F.col("used") < budget).withColumn(text, F.expr(f"substring({text}, 1, cast({budget} - used as int))")).drop("used")


def citations(answers: DataFrame, chunks: DataFrame) -> DataFrame:
    """answer_id, chunk_id, page_idx, snippet: chunk ids found in a text, in first order, with what they cite; unknown pages are -1."""
    found = answers.select("answer_id", F.posexplode(chunk_ids(F.col("text"))).alias("position", "chunk_id"))
    told = chunks.select("chunk_id", F.col("page_idx").alias("p"), "file_path", F.substring("content", 1, 320).alias("snippet"))
    return found.join(told, "chunk_id", "left").select("answer_id", "position", "chunk_id", "file_path", F.coalesce("p", F.lit(-1)).alias("page_idx"), "snippet")
