"""Lexical retrieval packing: texts of varying length into containers of fixed capacity.

The corpus is dealt into shards of bounded mass by content, each with a BM25 inverted index of its
own that weighs terms by their frequency in the whole corpus. Within a shard the longest unused item
seeds a container; the index returns its unused neighbours, best first, and those that fit fill the
window. What room is left goes to the longest unused items that still fit, so that every item finds
a container and little space stays unused. Items are split only where they exceed the capacity: into
full containers and a rest, which is packed like any other item.

Shards follow the content: centroids of hashed term vectors are fitted on a bounded sample
(FIT_ITEMS), every item goes to the cell of its two nearest centroids, and cells are merged or split
to shards of like mass. Neighbours in other shards are lost to a seed; recall() measures how many.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from spindle.llm.bpe import ByteBPE
from spindle.session import written

K1, B = 1.2, 0.75
#: Tokens and items of a shard, in the mean.
SHARD_TOKENS, SHARD_ITEMS = 2_000_000, 16_384
#: Items on which centroids are fitted, chosen by a hash; hashed dimensions of a vector; the most centroids; rounds of fitting.
FIT_ITEMS, DIMENSIONS, MOST_CENTROIDS, ROUNDS = 20_000, 512, 256, 10
#: Terms in more than this part of a shard's items are scored together as a matrix, for so many seeds at once.
FREQUENT, SEEDS = 0.05, 64


def sized(df: DataFrame, key: str, text: str, tokenizer: ByteBPE, rows: int = 256) -> DataFrame:
    """key, n_tokens, and the distinct tokens with their counts, of every row."""
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                ids = shared.value.encode_batch(part.column(1).to_pylist())
                both = [np.unique(np.asarray(x, np.int32), return_counts=True) for x in ids]
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(t) for t, _ in both])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([b[i] for b in both]).astype(np.int32))) for i in (0, 1)]
                n = pa.array([len(x) for x in ids], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), n, *lists], ["key", "n_tokens", "terms", "counts"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(
        run, f"key {kind}, n_tokens long, terms array<int>, counts array<int>"
    )


def document_frequencies(items: DataFrame) -> tuple[np.ndarray, int, float]:
    """How many items hold each term, how many hold any, and their mean length. Bounded by the vocabulary of the tokenizer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows, tokens = np.zeros(0, np.int64), 0, 0
        for batch in batches:
            n = np.bincount(batch.column(1).flatten().to_numpy(zero_copy_only=False), minlength=len(total))
            n[: len(total)] += total
            total, rows, tokens = n, rows + batch.num_rows, tokens + int(batch.column(0).to_numpy().sum())
        at = np.flatnonzero(total)
        # rows and tokens travel as terms of negative number
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2])), pa.array(np.append(total[at], [rows, tokens]))], ["term", "n"])

    counts = items.filter(F.col("n_tokens") > 0).select("n_tokens", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toPandas()
    told = dict(zip(counts["term"].tolist(), counts["n"].tolist()))
    rows, tokens = int(told.pop(-1, 0)), int(told.pop(-2, 0))
    df = np.zeros(max(told, default=-1) + 1, np.int64)
    df[list(told)] = list(told.values())
    return df, rows, tokens / max(1, rows)


def weights(terms: np.ndarray, counts: np.ndarray, lengths: np.ndarray, docs: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """The BM25 score that an item gains by each of its terms."""
    tf = counts.astype(np.float64)
    return (idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[docs] / max(1.0, mean)))).astype(np.float32)


def _lists(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a column of lists."""
    one = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    one = one.chunk(0) if isinstance(one, pa.ChunkedArray) else one
    offsets = one.offsets.to_numpy().astype(np.int64)
    return offsets - offsets[0], one.flatten().to_numpy(zero_copy_only=False)


def vectors(lengths: np.ndarray, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """Unit vectors of items: the weights of their terms, hashed to few dimensions with a sign."""
    docs = np.repeat(np.arange(len(lengths)), np.diff(offsets))
    h = (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
    w = weights(terms, counts, lengths, docs, idf, mean) * np.where((h >> np.uint64(20)) & np.uint64(1), 1, -1)
    x = np.bincount(docs * DIMENSIONS + (h % np.uint64(DIMENSIONS)).astype(np.int64), weights=w, minlength=len(lengths) * DIMENSIONS).reshape(-1, DIMENSIONS)
    return (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)).astype(np.float32)


def centroids(x: np.ndarray, k: int) -> np.ndarray:
    """At most k unit vectors, by alternating assignment and mean from a fixed start."""
    if k < 2 or len(x) <= k:
        return x[: max(1, k)] if len(x) else np.zeros((1, DIMENSIONS), np.float32)
    c = x[np.random.default_rng(1).choice(len(x), k, replace=False)].copy()
    for _ in range(ROUNDS):
        a = (x @ c.T).argmax(1)
        for i in range(k):
            here = x[a == i]
            if len(here):
                c[i] = here.sum(0)
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
    return c


def in_cells(items: DataFrame, df: np.ndarray, rows: int, mean: float, shards: int) -> DataFrame:
    """items with cell: the two nearest centroids, as one number."""
    idf = np.log1p((rows - df + 0.5) / (df + 0.5))
    shared = items.sparkSession.sparkContext.broadcast(idf)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms = _lists(batch.column(1))
            x = vectors(batch.column(0).to_numpy(), offsets, terms, _lists(batch.column(2))[1], shared.value, mean)
            yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in x], pa.binary())], ["v"])

    # so many in the mean, by a hash: nothing is sorted or moved for that
    sample = items.filter((F.col("n_tokens") > 0) & (F.pmod(F.xxhash64("key", "n_tokens"), F.lit(max(1, rows))) < FIT_ITEMS)).select("n_tokens", "terms", "counts")
    raw = sample.mapInArrow(project, "v binary").toPandas()["v"]
    x = np.frombuffer(b"".join(raw), np.float32).reshape(-1, DIMENSIONS)
    c = items.sparkSession.sparkContext.broadcast(centroids(x, min(shards, MOST_CENTROIDS)))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, terms = _lists(batch.column(2))
            x = vectors(batch.column(1).to_numpy(), offsets, terms, _lists(batch.column(3))[1], shared.value, mean)
            near = x @ c.value.T
            first = near.argmax(1)
            near[np.arange(len(near)), first] = -2
            cell = first * MOST_CENTROIDS + near.argmax(1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], [*batch.schema.names, "cell"])

    kind = items.schema["key"].dataType.simpleString()
    return items.select("key", "n_tokens", "terms", "counts").mapInArrow(assign, f"key {kind}, n_tokens long, terms array<int>, counts array<int>, cell int")


def shard_plan(cells: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """cell, first shard and number of shards from cells with their tokens and items: great cells are split, small ones of one centroid share a shard.

    A centroid whose rest is less than half a shard goes on with the next one's cells.
    """
    plan: list[tuple[int, int, int]] = []
    shard, load, centroid = 0, 0.0, -1
    for cell, tokens, items in sorted(cells):
        mass = max(tokens / SHARD_TOKENS, items / SHARD_ITEMS)
        if load and (load + mass > 1.25 or (cell // MOST_CENTROIDS != centroid and load >= 0.5)):
            shard, load = shard + 1, 0.0
        centroid = cell // MOST_CENTROIDS
        parts = max(1, round(mass))
        plan.append((cell, shard, parts))
        if parts > 1:
            shard, load = shard + parts, 0.0
        else:
            load += mass
    return plan


class Index:
    """BM25 over the items of one shard. Terms that many items hold are a matrix, the others are postings."""

    def __init__(self, lengths: np.ndarray, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, df: np.ndarray | None = None, rows: int | None = None, mean: float | None = None):
        n = len(lengths)
        docs = np.repeat(np.arange(n), np.diff(offsets))
        vocabulary, which, here = np.unique(terms, return_inverse=True, return_counts=True)
        df, rows = (here, n) if df is None else (df[vocabulary], rows)
        idf = np.log1p((rows - df + 0.5) / (df + 0.5))
        weight = weights(which, counts, lengths, docs, idf, lengths.mean() if mean is None and n else mean or 1.0)
        often = here > FREQUENT * n
        column = np.cumsum(often) - 1
        dense = often[which]
        self.matrix = np.zeros((int(often.sum()), n), np.float32)
        self.matrix[column[which[dense]], docs[dense]] = weight[dense]
        order = np.flatnonzero(~dense)
        order = order[np.argsort(which[order], kind="stable")]
        self.docs, self.weight = docs[order], weight[order]
        self.end = np.cumsum(np.where(often, 0, here))
        self.start = self.end - np.where(often, 0, here)
        self.offsets, self.which, self.often, self.column, self.here, self.n = offsets, which, often, column, here, n
        self.ready: dict[int, np.ndarray] = {}

    def prepare(self, items: list[int]) -> None:
        """Scores by frequent terms for items that are likely to be asked about next, all at once."""
        rows = np.zeros((len(items), len(self.matrix)), np.float32)
        for r, i in enumerate(items):
            t = self.which[self.offsets[i] : self.offsets[i + 1]]
            rows[r, self.column[t[self.often[t]]]] = 1
        self.ready = dict(zip(items, rows @ self.matrix))

    def scores(self, item: int) -> np.ndarray:
        """The BM25 score of every item of the shard for all terms of item."""
        if item not in self.ready:
            self.prepare([item])
        score = self.ready.pop(item)
        t = self.which[self.offsets[item] : self.offsets[item + 1]]
        for x in t[~self.often[t] & (self.here[t] > 1)].tolist():
            score[self.docs[self.start[x] : self.end[x]]] += self.weight[self.start[x] : self.end[x]]
        return score

    def neighbours(self, item: int, open_: np.ndarray, most: int, sizes: np.ndarray) -> Iterator[np.ndarray]:
        """Open items of at most that size which share a term with item, best first, in parts of growing length."""
        score = self.scores(item)
        d = np.flatnonzero(open_ & (sizes <= most) & (score > 0))
        s, step = score[d], 64
        while len(d):  # most windows are full after the best few
            best = np.argpartition(-s, step)[:step] if len(d) > step else np.arange(len(d))
            cut = s[best].min()
            best = np.flatnonzero(s >= cut)  # all of equal score, so that ties go to the earlier
            yield d[best[np.argsort(-s[best], kind="stable")]]
            d, s, step = d[s < cut], s[s < cut], step * 8


def pack(lengths: np.ndarray, index: Index, capacity: int) -> tuple[list[int], list[int], list[int], list[int], list[int]]:
    """item, piece, start, tokens and container of every piece of the items of one shard."""
    items: list[int] = []
    piece: list[int] = []
    start: list[int] = []
    size: list[int] = []
    box: list[int] = []
    boxes = 0

    def put(i: int, p: int, s: int, n: int, b: int) -> None:
        items.append(i), piece.append(p), start.append(s), size.append(n), box.append(b)

    full, rest = lengths // capacity, lengths % capacity
    for i in np.flatnonzero(full).tolist():
        for p in range(int(full[i])):
            put(i, p, p * capacity, capacity, boxes)
            boxes += 1
    open_ = rest > 0
    by_size: list[list[int]] = [[] for _ in range(capacity)]
    for i in np.flatnonzero(open_)[::-1].tolist():
        by_size[rest[i]].append(i)
    present = sum(1 << n for n in range(1, capacity) if by_size[n])  # a bit for each size that may be open

    def longest(most: int) -> int:
        """An open item of the greatest size up to most, or -1."""
        nonlocal present
        while n := (present & ((1 << (most + 1)) - 1)).bit_length() - 1:
            if n < 0:
                return -1
            stack = by_size[n]
            while stack and not open_[stack[-1]]:
                stack.pop()
            if stack:
                return stack[-1]
            present &= ~(1 << n)
        return -1

    seeds = np.flatnonzero(open_)
    seeds, at = seeds[np.argsort(-rest[seeds], kind="stable")].tolist(), 0  # in the order in which longest gives them
    while (seed := longest(capacity - 1)) >= 0:
        room, chosen = capacity - int(rest[seed]), [seed]
        open_[seed] = False
        if room:
            if seed not in index.ready:
                while seeds[at] != seed:
                    at += 1
                index.prepare([seed, *[i for i in seeds[at + 1 : at + 2 * SEEDS] if open_[i]][: SEEDS - 1]])
            for some in index.neighbours(seed, open_, room, rest):
                size_of, at_ = rest[some], 0
                while room and len(fits := np.flatnonzero(size_of[at_:] <= room)):
                    at_ += int(fits[0])
                    i = int(some[at_])
                    chosen.append(i)
                    open_[i] = False
                    room -= int(rest[i])
                    at_ += 1
                if not room:
                    break
            while room and (i := longest(room)) >= 0:
                chosen.append(i)
                open_[i] = False
                room -= int(rest[i])
        for i in chosen:
            put(i, int(full[i]), int(full[i]) * capacity, int(rest[i]), boxes)
        boxes += 1
    for i in np.flatnonzero(lengths == 0).tolist():
        put(i, 0, 0, 0, -1)
    return items, piece, start, size, box


def in_shards(items: DataFrame) -> tuple[DataFrame, np.ndarray, int, float]:
    """items (key, n_tokens, terms, counts) with shard, and the frequencies, number and mean length of all items."""
    df, rows, mean = document_frequencies(items)
    shards = max(1, -(-int(rows * mean) // SHARD_TOKENS), -(-rows // SHARD_ITEMS))
    # the cell is made twice, for the plan and for the shards: that takes less than to write all items once more
    celled = in_cells(items, df, rows, mean, shards) if shards > 1 else items.withColumn("cell", F.lit(0))
    # at most MOST_CENTROIDS squared rows
    cells = celled.groupBy("cell").agg(F.sum("n_tokens"), F.count(F.lit(1))).collect()
    plan = items.sparkSession.createDataFrame(shard_plan([tuple(r) for r in cells]) or [(0, 0, 1)], "cell int, first int, parts int")
    part = F.pmod(F.xxhash64("key", "n_tokens"), F.col("parts")).cast("int")
    return celled.join(F.broadcast(plan), "cell").withColumn("shard", F.col("first") + part).drop("cell", "first", "parts"), df, rows, mean


def pack_documents(df: DataFrame, key: str, text: str, capacities: dict[int, int], tokenizer: ByteBPE, name: str = "packing") -> DataFrame:
    """spec_id, container_id, key, piece, token_start, n_tokens: where each piece of each text goes.

    Tokens are those of tokenizer. The pieces of a text follow one another without gap; only a
    text longer than the capacity has more than one. Null and empty texts take no space: one row
    with n_tokens 0 and a null container_id. Repeated keys are items of their own. Empty tables
    give no rows. capacities maps spec_id to a capacity of at least one token.
    """
    if any(c < 1 for c in capacities.values()):
        raise ValueError("a capacity must be at least one token")
    items = written(sized(df, key, text, tokenizer), f"{name}-sized")
    kind = items.schema["key"].dataType.simpleString()
    sharded, frequencies, rows, mean = in_shards(items)
    shared = df.sparkSession.sparkContext.broadcast(frequencies)

    def run(table: pa.Table) -> pa.Table:
        # columns of lists are joined here; the order of arrival must not matter
        table = table.combine_chunks().sort_by([("n_tokens", "descending"), ("key", "ascending")]).combine_chunks()
        lengths = table.column("n_tokens").to_numpy()
        offsets, terms = _lists(table.column("terms"))
        index = Index(lengths, offsets, terms, _lists(table.column("counts"))[1], shared.value, rows, mean)
        shard, out = table.column("shard")[0].as_py() if len(lengths) else 0, []
        for spec, capacity in capacities.items():
            item, piece, start, size, box = (np.asarray(x, np.int64) for x in pack(lengths, index, capacity))
            none = box < 0
            out.append(pa.table({
                "spec_id": pa.array(np.full(len(item), spec, np.int32)),
                "container_id": pa.array((np.int64(shard) << 32) + box, mask=none),
                "key": table.column("key").take(pa.array(item)),
                "piece": pa.array(piece.astype(np.int32)), "token_start": pa.array(start), "n_tokens": pa.array(size),
            }))
        return pa.concat_tables(out)

    return (
        sharded.groupBy("shard")
        .applyInArrow(run, f"spec_id int, container_id long, key {kind}, piece int, token_start long, n_tokens long")
        .withColumnRenamed("key", key)
    )


def recall(df: DataFrame, key: str, text: str, tokenizer: ByteBPE, k: int = 10, seeds: int = 500, name: str = "packing") -> DataFrame:
    """n_seeds, n_neighbours, recall: the share of the k nearest items of seeds by BM25 over the whole corpus that lie in the seed's shard.

    Seeds are the first by a hash (their number is a bound of this measure, not of the packing); each
    is held against all items, of which every part gives its k best.
    """
    items = written(sized(df, key, text, tokenizer), f"{name}-sized")
    sharded, frequencies, rows, mean = in_shards(items)
    sharded = written(sharded.filter(F.col("n_tokens") > 0).select(F.xxhash64("key", "n_tokens", "terms").alias("item"), "shard", "n_tokens", "terms", "counts"), f"{name}-items")
    chosen = sharded.orderBy(F.xxhash64("item"), "item").limit(seeds).toPandas()
    idf = np.log1p((rows - frequencies + 0.5) / (frequencies + 0.5))
    asked = np.zeros((len(chosen), len(idf)), np.float32)
    for r, t in enumerate(chosen["terms"]):
        asked[r, t] = 1
    shared = df.sparkSession.sparkContext.broadcast((chosen["item"].to_numpy(np.int64), np.flatnonzero(asked.any(0)), asked[:, asked.any(0)], idf))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seed, used, q, idf = shared.value
        column = np.full(len(idf), -1)
        column[used] = np.arange(len(used))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                offsets, terms = _lists(part.column(3))
                docs = np.repeat(np.arange(part.num_rows), np.diff(offsets))
                w = weights(terms, _lists(part.column(4))[1], part.column(2).to_numpy(), docs, idf, mean)
                m, here = np.zeros((part.num_rows, len(used)), np.float32), column[terms] >= 0
                m[docs[here], column[terms[here]]] = w[here]
                s = q @ m.T
                item = part.column(0).to_numpy()
                s[seed[:, None] == item[None, :]] = 0
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                score = np.take_along_axis(s, best, 1)
                r, c = np.nonzero(score > 0)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(seed[r]), pa.array(item[best[r, c]]), part.column(1).take(pa.array(best[r, c])), pa.array(score[r, c])], ["seed", "item", "shard", "score"]
                )

    near = sharded.mapInArrow(run, "seed long, item long, shard int, score float")
    rank = F.row_number().over(Window.partitionBy("seed").orderBy(F.desc("score"), "item"))
    top = near.withColumn("rank", rank).filter(F.col("rank") <= k)
    own = sharded.select(F.col("item").alias("seed"), F.col("shard").alias("own")).distinct()
    return top.join(own, "seed").agg(
        F.countDistinct("seed").alias("n_seeds"), F.count(F.lit(1)).alias("n_neighbours"), F.round(F.avg((F.col("shard") == F.col("own")).cast("int")), 4).alias("recall")
    )


def fill_report(packed: DataFrame, capacities: dict[int, int]) -> DataFrame:
    """Per spec: containers, tokens, capacity and the share of space that is used."""
    capacity = F.create_map(*[F.lit(x) for kv in capacities.items() for x in kv])[F.col("spec_id")]
    per_box = packed.filter(F.col("container_id").isNotNull()).groupBy("spec_id", "container_id").agg(F.sum("n_tokens").alias("n"))
    return per_box.groupBy("spec_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_tokens")).select(
        "spec_id", capacity.alias("capacity_tokens"), "n_containers", "n_tokens",
        F.round(F.col("n_tokens") / (F.col("n_containers") * capacity), 6).alias("fill"),
    )
