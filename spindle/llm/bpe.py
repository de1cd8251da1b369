"""Byte-pair encoding of whole corpora with a public tokenizer.

Two tiers. A minimal perfect hash over the vocabulary resolves pre-tokens that are one token
as they stand: pre-tokens are hashed, looked up in one array operation per batch, and verified
against the key in their slot. The misses are merged from their bytes: the symbols form a
linked list, a heap holds the adjacent pairs by rank and place, so that a run of n bytes costs
O(n log n), however long. Results of a worker are kept in a table of bounded size.

The tables come from the tokenizer's own file, whose path is a parameter. They have the size
of the vocabulary and are the only thing broadcast.
"""

from __future__ import annotations

import heapq
import importlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame, functions as F

TOKENIZERS_DIR = os.environ.get("SPINDLE_TOKENIZERS", "/opt/tokenizers")
#: Pre-tokens whose ids a worker keeps; beyond it the table is emptied, which costs time but no result.
KEPT = 200_000
#: A pre-token of more bytes than this isn't kept.
KEPT_BYTES = 256


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in byte-level vocabulary files, by the public rule."""
    plain = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    for b in range(256):
        if b not in plain:
            out[chr(256 + len(out) - len(plain))] = b
    return out


def pattern_of(directory: str) -> str:
    """The pre-tokenization pattern published with the files."""
    spec = importlib.util.spec_from_file_location("_tokenizer_files", os.path.join(directory, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module.PATTERN


class PerfectHash:
    """Hash and displace: key i of n distinct byte strings gets a slot of its own among n slots."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.seed = 0
        while not self._build(keys, max(1, n // 3)):
            self.seed += 1

    def hashes(self, keys: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(k, self.seed) for k in keys), np.uint64, len(keys))

    def _build(self, keys: list[bytes], m: int) -> bool:
        h = self.hashes(keys)
        n, self.m = self.n, m
        self.moves = np.zeros(m, np.int64)
        self.order = np.full(n, -1, np.int64)
        if not n:
            return True
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate((h % np.uint64(m)).tolist()):
            buckets.setdefault(b, []).append(i)
        free = np.ones(n, bool)
        singles = []
        for b, members in sorted(buckets.items(), key=lambda x: -len(x[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            own, base = h[members], 0
            while base < 1 << 17:
                tries = np.arange(base, base + (32 if len(members) > 2 and not base else 512), dtype=np.uint64)
                slots = self._place(own[None, :], tries[:, None])
                found = next((k for k in np.flatnonzero(free[slots].all(1)).tolist() if len(set(slots[k].tolist())) == len(members)), None)
                if found is not None:
                    self.moves[b] = base + found
                    free[slots[found]] = False
                    self.order[slots[found]] = members
                    break
                base += len(tries)
            else:
                return False
        for (b, i), slot in zip(singles, np.flatnonzero(free).tolist()):
            self.moves[b] = -slot - 1  # a lone key names its slot itself
            self.order[slot] = i
        return True

    def _place(self, h: np.ndarray, move: np.ndarray) -> np.ndarray:
        """The slot of a hash displaced by move: both are mixed, so that each move deals the slots anew."""
        x = h + move * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(self.n)).astype(np.int64)

    def slots(self, keys: list[bytes]) -> np.ndarray:
        """The slot of each key; any byte string has one, so the caller compares the key found there."""
        if not self.n:
            return np.full(len(keys), -1, np.int64)
        h = self.hashes(keys)
        move = self.moves[(h % np.uint64(self.m)).astype(np.int64)]
        return np.where(move < 0, -move - 1, self._place(h, np.maximum(move, 0).astype(np.uint64)))


class ByteBPE:
    """A byte-level tokenizer read from a file of vocabulary and merges (.json)."""

    def __init__(self, name: str = "byte_bpe_50k", directory: str = TOKENIZERS_DIR):
        with open(os.path.join(directory, f"{name}.json"), encoding="utf-8") as f:
            model = json.load(f)["model"]
        symbol = byte_symbols()
        vocab = {bytes(symbol[c] for c in t): i for t, i in model["vocab"].items() if all(c in symbol for c in t)}
        self.pattern = pattern_of(directory)
        self.byte_ids = [vocab[bytes([b])] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = (bytes(symbol[c] for c in x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        # special tokens aren't made by merging; nor does every token result from merging its own bytes
        whole = [t for t, i in vocab.items() if self.merged(t) == [i]]
        self.hash = PerfectHash(whole)
        self.keys = [whole[i] for i in self.hash.order.tolist()]
        self.ids = [vocab[k] for k in self.keys]
        self._ready()

    def _ready(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.kept: dict[str, list[int]] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "kept")}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._ready()

    def merged(self, piece: bytes) -> list[int]:
        """Ids of a byte string: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.byte_ids[b] for b in piece]
        n = len(ids)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        merges = self.merges
        heap = [(*m, i, ids[i], ids[i + 1]) for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, new, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue  # one of the two was merged meanwhile
            ids[i], ids[j] = new, -1
            k = after[i] = after[j]
            after[j] = -1
            if k >= 0:
                before[k] = i
                if m := merges.get((new, ids[k])):
                    heapq.heappush(heap, (*m, i, new, ids[k]))
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], new))):
                heapq.heappush(heap, (*m, h, ids[h], new))
        return [x for x in ids if x >= 0]

    def resolve(self, pieces: list[str]) -> dict[str, list[int]]:
        """Ids of distinct pre-tokens."""
        raw = [p.encode("utf-8", "surrogatepass") for p in pieces]
        keys, ids = self.keys, self.ids
        out = {}
        for p, r, s in zip(pieces, raw, self.hash.slots(raw).tolist()):
            out[p] = [ids[s]] if s >= 0 and keys[s] == r else self.merged(r)
        return out

    def encode_batch(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text without special tokens; their strings are ordinary text. Null and empty give no ids."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.kept) > KEPT:
            self.kept = {}
        kept = self.kept
        new = {p for pieces in split for p in pieces if p not in kept}
        table = kept
        if new:
            found = self.resolve(list(new))
            kept.update((p, x) for p, x in found.items() if len(p) <= KEPT_BYTES)
            table = kept if len(kept) >= len(found) and all(len(p) <= KEPT_BYTES for p in found) else {**found, **kept}
        out = []
        for pieces in split:
            ids: list[int] = []
            for p in pieces:
                ids += table[p]
            out.append(ids)
        return out


def id_lists(lists: list[list[int]]) -> pa.ListArray:
    offsets = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat))


def encode(df: DataFrame, key: str, text: str, tokenizer: ByteBPE, rows: int = 256) -> DataFrame:
    """key and ids (ARRAY<INT>) of every row of df; ids is empty, never null, for null and empty texts.

    Rows are kept as they are: repeated keys stay repeated, a null key stays null, and other
    columns are neither read nor kept. Whole texts are encoded, whatever their length. Arrow
    batches are cut into groups of rows texts, so that a worker holds few texts at once.
    """
    shared = df.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                yield pa.RecordBatch.from_arrays([part.column(0), id_lists(t.encode_batch(part.column(1).to_pylist()))], ["key", "ids"])

    kind = df.schema[key].dataType.simpleString()
    return (
        df.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        .mapInArrow(run, f"key {kind}, ids array<int>")
        .withColumnRenamed("key", key)
    )
