import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from spindle.llm.bpe import ByteBPE, PerfectHash, encode
from spindle.llm import packing
from spindle.llm.packing import Index, fill_report, pack, pack_documents, recall, shard_plan


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE()


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    t.encode_special_tokens = True
    return t


def test_perfect_hash():
    keys = [f"key{i}".encode() for i in range(3000)]
    h = PerfectHash(keys)
    assert sorted(h.slots(keys).tolist()) == list(range(3000)) and [keys[i] for i in h.order[h.slots(keys)].tolist()] == keys
    assert PerfectHash([]).slots([b"a"]).tolist() == [-1] and PerfectHash([b"a"]).slots([b"a"]).tolist() == [0]


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(bpe, library, text):
    assert bpe.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["<|endoftext|>", "a" * 30_000, "中文没有空格" * 3000, " \t\n" * 5000, "don't  we'LL\x00\x1c\x85"])
def test_hard_texts(bpe, library, text):
    assert bpe.encode_batch([text])[0] == library.encode(text, add_special_tokens=False).ids


def test_encode(spark, bpe):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (2, None), (3, ""), (None, "x")], "doc_id long, text string").selectExpr("*", "'clash' key", "'clash' ids")
    got = sorted(((r["doc_id"], r["ids"]) for r in encode(df, "doc_id", "text", bpe).collect()), key=str)
    ab = bpe.encode_batch(["a b"])[0]
    assert got == sorted([(1, ab), (1, ab), (2, []), (3, []), (None, bpe.encode_batch(["x"])[0])], key=str)
    assert encode(df.limit(0), "doc_id", "text", bpe).count() == 0


def test_packing(spark, bpe):
    rows = [(i, "word " * (1 + i % 40)) for i in range(150)] + [(900, None), (901, ""), (902, "long text " * 2000), (7, "word " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 shard", "0 n_tokens")
    out = pack_documents(df, "doc_id", "text", {1: 32, 2: 100}, bpe)
    got = out.collect()
    size = {}
    for r in encode(df, "doc_id", "text", bpe).collect():
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + len(r["ids"])
    for spec, capacity in ((1, 32), (2, 100)):
        box, doc = {}, {}
        for r in got:
            if r["spec_id"] == spec:
                doc[r["doc_id"]] = doc.get(r["doc_id"], 0) + r["n_tokens"]
                if r["container_id"] is not None:
                    box[r["container_id"]] = box.get(r["container_id"], 0) + r["n_tokens"]
        assert doc == size and max(box.values()) <= capacity and len(box) <= 1.1 * -(-sum(size.values()) // capacity) + 1
        pieces = [r for r in got if r["spec_id"] == spec and r["doc_id"] == 902]
        assert sorted(r["token_start"] for r in pieces) == [i * capacity for i in range(len(pieces))]
        assert all(sum(1 for x in got if x["spec_id"] == spec and x["doc_id"] == i) == 1 for i in range(20, 30) if size[i] <= capacity)
    assert {r["doc_id"] for r in got if r["container_id"] is None} == {900, 901}
    assert fill_report(out, {1: 32, 2: 100}).count() == 2
    assert pack_documents(df.limit(0), "doc_id", "text", {1: 32}, bpe).count() == 0
    with pytest.raises(ValueError):
        pack_documents(df, "doc_id", "text", {1: 0}, bpe)


def test_neighbours_share_terms():
    terms = [np.array([1, 2, 3]), np.array([1, 2, 9]), np.array([50, 51]), np.array([3, 60])]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    lengths = np.array([10, 10, 10, 10])
    index = Index(lengths, offsets, np.concatenate(terms), np.ones(offsets[-1], np.int64))
    assert np.concatenate(list(index.neighbours(0, np.array([False, True, True, True]), 10, lengths))).tolist() == [1, 3]
    item, *_, box = pack(lengths, index, 20)
    assert sorted(item) == [0, 1, 2, 3] and max(box) == 1


def test_neighbours_share_any_term():
    # item 0 shares terms 0 to 19 with item 1, and each of the terms 20 to 31, which are rarer for it, with none but item 2
    terms = [list(range(32)), list(range(20)), list(range(20, 32)), list(range(20)), [99]]
    flat = np.concatenate(terms)
    lengths = np.array([len(t) for t in terms])
    index = Index(lengths, np.concatenate([[0], np.cumsum(lengths)]), flat, np.ones(len(flat), np.int64))
    got = np.concatenate(list(index.neighbours(0, np.array([False, True, True, True, True]), 100, lengths)))
    assert sorted(got) == [1, 2, 3]


def brute_scores(item, lengths, offsets, terms, counts):
    """BM25 of every item for the terms of one, term by term."""
    n, own = len(lengths), set(terms[offsets[item] : offsets[item + 1]].tolist())
    df = {t: int((terms == t).sum()) for t in own}
    out = np.zeros(n)
    for d in range(n):
        for t, tf in zip(terms[offsets[d] : offsets[d + 1]].tolist(), counts[offsets[d] : offsets[d + 1]].tolist()):
            if t in own:
                norm = packing.K1 * (1 - packing.B + packing.B * lengths[d] / lengths.mean())
                out[d] += np.log1p((n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (packing.K1 + 1) / (tf + norm)
    return out


def test_scores_equal_brute_force():
    r = np.random.default_rng(3)
    docs = [np.unique(np.minimum(r.zipf(1.3, 30), 400)) for _ in range(120)]
    offsets, terms = np.concatenate([[0], np.cumsum([len(d) for d in docs])]), np.concatenate(docs)
    counts = r.integers(1, 6, len(terms))
    lengths = np.array([int(counts[offsets[i] : offsets[i + 1]].sum()) for i in range(120)])
    index = Index(lengths, offsets, terms, counts)
    assert len(index.matrix) and len(index.docs)
    for item in (0, 7, 119):
        want = brute_scores(item, lengths, offsets, terms, counts)
        others = np.arange(120) != item  # an item's own score is never looked at
        assert np.allclose(index.scores(item)[others], want[others], rtol=1e-4, atol=1e-3)
        got = np.concatenate(list(index.neighbours(item, np.arange(120) != item, 10_000, lengths))).tolist()
        assert sorted(got) == [i for i in range(120) if i != item and want[i] > 0]
        assert all(want[a] >= want[b] - 1e-3 for a, b in zip(got, got[1:]))


def test_shard_plan():
    tokens, items = packing.SHARD_TOKENS, packing.SHARD_ITEMS
    m = packing.MOST_CENTROIDS
    plan = dict((c, (s, p)) for c, s, p in shard_plan([(1, 3 * tokens, 5), (2, tokens // 10, 1), (3, tokens // 10, 1), (m, tokens // 10, 4 * items), (2 * m, 1, 1)]))
    assert plan[1] == (0, 3) and plan[2] == plan[3] == (3, 1) and plan[m][1] == 4
    assert shard_plan([]) == []


def test_shards_by_content(spark, bpe, monkeypatch):
    monkeypatch.setattr(packing, "SHARD_TOKENS", 400)
    topics = ["red apple tree fruit", "steel engine wheel motor", "river lake water fish"]
    rows = [(i, " ".join([topics[i % 3]] * (3 + i % 5))) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    items = packing.sized(df, "doc_id", "text", bpe)
    shards = {}
    for r in packing.in_shards(items)[0].collect():
        shards.setdefault(r["shard"], set()).add(r["key"] % 3)
    assert len(shards) > 3 and sum(len(v) == 1 for v in shards.values()) >= len(shards) - 2
    out = pack_documents(df, "doc_id", "text", {1: 64}, bpe).collect()
    assert {r["doc_id"] for r in out} == set(range(90))
    assert recall(df, "doc_id", "text", bpe, k=5, seeds=20).first()["recall"] > 0.2
