"""Ids, keys and the state of documents: item hashes, cache validity, restored checkpoints, appended chunks and merged entities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F


from spindle.operators.records import latest_version

#: Keys of a block that make its hash (fixed values), in the order of their names.
HASHED = ("image_caption", "image_footnote", "img_caption", "img_footnote", "img_path", "page_idx", "table_body", "table_caption", "table_footnote", "text", "type")
#: A token where no tokenizer is given: a Chinese character, a word, or any other mark.
TOKEN = r"\p{IsHan}|[\p{L}\p{N}&&[^\p{IsHan}]]+|[^\s\p{L}\p{N}]"


def quoted(c: Column) -> Column:
    """A string as JSON."""
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def item_json(blocks: DataFrame, index: Column) -> Column:
    """A block as JSON with sorted keys, null ones left out, and index among them; what its hash is made of."""
    kinds = dict(blocks.dtypes)

    def pair(name: str) -> Column:
        if name == "index":
            value, there = index.cast("string"), index.isNotNull()
        else:
            c, there = F.col(name), F.col(name).isNotNull()
            value = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: F.coalesce(quoted(x), F.lit("null"))), ", "), F.lit("]")) if kinds[name].startswith("array") else quoted(c) if kinds[name] == "string" else c.cast("string")
        return F.when(there, F.concat(F.lit(f'"{name}": '), value))

    return F.concat(F.lit("{"), F.concat_ws(", ", *[pair(n) for n in sorted((*[h for h in HASHED if h in kinds], "index"))]), F.lit("}"))


def item_hashes(blocks: DataFrame) -> DataFrame:
    """file_path, block_idx, item_idx, item_hash of the blocks of a file that aren't text, numbered from 0 in reading order.

    Numbers come from counts by ranges of the order and a rank within each, so that a great file isn't ranked in one task.
    """
    items = blocks.filter(F.col("type") != "text").withColumn("part", F.floor(F.col("block_idx") / 1000))
    before = items.groupBy("file_path", "part").agg(F.count(F.lit(1)).alias("n")).withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    r = F.row_number().over(Window.partitionBy("file_path", "part").orderBy("block_idx", "block_id"))
    numbered = items.withColumn("r", r).join(before.drop("n"), ["file_path", "part"]).withColumn("item_idx", (F.col("before") + F.col("r") - 1).cast("int"))
    return numbered.withColumn("item_hash", F.md5(item_json(blocks, F.col("item_idx")))).select("file_path", "block_idx", "item_idx", "item_hash")


def signatures(hashes: DataFrame) -> DataFrame:
    """file_path, signature, n_items: a hash of the item hashes of a file in order. Only hashes are gathered."""
    ordered = F.array_sort(F.collect_list(F.struct("item_idx", "item_hash")))["item_hash"]
    return hashes.groupBy("file_path").agg(F.md5(F.array_join(ordered, "||")).alias("signature"), F.count(F.lit(1)).alias("n_items"))


def valid_parses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """files (file_path, mtime, config) with valid: the cache (the same, doc_id and n_blocks) has a result of this very state and configuration.

    Of several cached rows of a file any that fits counts.
    """
    fits = F.coalesce(F.col("doc_id"), F.lit("")) != ""
    known = cache.filter(fits & (F.coalesce("n_blocks", F.lit(0)) > 0)).select("file_path", "mtime", "config").distinct().withColumn("valid", F.lit(True))
    return files.join(known, ["file_path", "mtime", "config"], "left").withColumn("valid", F.coalesce("valid", F.lit(False)))


def hard_skip(now: DataFrame, done: DataFrame) -> DataFrame:
    """now (file_path, signature) with skip: it was completed before with the same signature; done has completed besides."""
    d = done.filter(F.coalesce("completed", F.lit(False))).select("file_path", "signature").distinct().withColumn("skip", F.lit(True))
    return now.join(d, ["file_path", "signature"], "left").withColumn("skip", F.coalesce("skip", F.lit(False)))


def restored(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """items with description and entity of the cache where that has a valid row, and restored; the rest is to be done.

    A cached row is valid if its description or its entity (text) isn't blank; the latest by version counts.
    """
    said = (F.trim(F.coalesce("description", F.lit(""))) != "") | (F.trim(F.coalesce("entity", F.lit(""))) != "")
    c = latest_version(cache.filter(said).select(*keys, "description", "entity", "version"), *keys, order="version").drop("version")
    return items.join(c.withColumn("restored", F.lit(True)), keys, "left").withColumn("restored", F.coalesce("restored", F.lit(False)))


def fully_processed(status: DataFrame) -> DataFrame:
    """status (doc_id, status, multimodal_processed) with done: both the text and everything else is processed."""
    return status.withColumn("done", F.coalesce(F.lower("status") == "processed", F.lit(False)) & F.coalesce("multimodal_processed", F.lit(False)))


def document_statuses(documents: DataFrame, status: DataFrame) -> DataFrame:
    """Each document (doc_id) with what is known of it, and defaults where nothing is: exists, status, chunks_count, text and multimodal processed, done."""
    s = latest_version(status, "doc_id", order="updated_at").withColumn("exists", F.lit(True))
    out = documents.select("doc_id").distinct().join(s, "doc_id", "left")
    text = F.coalesce(F.lower("status") == "processed", F.lit(False))
    media = F.coalesce("multimodal_processed", F.lit(False))
    return out.select(
        "doc_id", F.coalesce("exists", F.lit(False)).alias("exists"), F.coalesce("status", F.lit("not_found")).alias("status"), F.coalesce("chunks_count", F.lit(0)).alias("chunks_count"),
        text.alias("text_processed"), media.alias("multimodal_processed"), (text & media).alias("done"),
    )


def merged_names(stored: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id, entity_names, count: stored names in their order, then those of found that are new, each once; documents on either side.

    found has doc_id, name and place; the first place of a name counts. Blank names don't.
    """
    s = stored.select("doc_id", F.posexplode_outer("entity_names").alias("place", "name")).select("doc_id", "name", F.struct(F.lit(0).alias("from"), F.col("place").cast("long").alias("place")).alias("at"))
    f = found.select("doc_id", "name", F.struct(F.lit(1).alias("from"), F.col("place").cast("long").alias("place")).alias("at"))
    first = s.unionByName(f).groupBy("doc_id", "name").agg(F.min("at").alias("at"))
    named = F.when(F.trim(F.coalesce("name", F.lit(""))) != "", F.struct("at", "name"))
    out = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(named))["name"].alias("entity_names"))
    return out.withColumn("count", F.size("entity_names"))


def appended_chunks(status: DataFrame, added: DataFrame) -> DataFrame:
    """status (doc_id, chunks_list, chunks_count) with the chunks of added (doc_id, chunk_id, place) at the end, in order, repeated ones too, and counted."""
    a = added.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("place", "chunk_id")))["chunk_id"].alias("more"))
    none = F.array().cast("array<string>")
    out = status.join(a, "doc_id", "full").withColumn("more", F.coalesce("more", none))
    return out.select("doc_id", F.concat(F.coalesce("chunks_list", none), "more").alias("chunks_list"), (F.coalesce("chunks_count", F.lit(0)) + F.size("more")).alias("chunks_count"))


def chunk_order(added: DataFrame, status: DataFrame) -> DataFrame:
    """added (doc_id, chunk_id, place) with chunk_order_index: it follows the chunks that the document has."""
    r = F.row_number().over(Window.partitionBy("doc_id").orderBy("place", "chunk_id")) - 1
    return added.withColumn("r", r).join(status.select("doc_id", "chunks_count"), "doc_id", "left").withColumn("chunk_order_index", F.coalesce("chunks_count", F.lit(0)) + F.col("r")).drop("r", "chunks_count")


def modal_edges(chunks: DataFrame, entities: DataFrame) -> DataFrame:
    """source, target, chunk_id, relation, weight: what is extracted from the chunk of a modal entity belongs to it.

    chunks has chunk_id and modal_entity_name, entities chunk_id and name; the modal entity isn't part of itself.
    """
    m = chunks.filter(F.coalesce("modal_entity_name", F.lit("")) != "").select("chunk_id", F.col("modal_entity_name").alias("target")).distinct()
    e = entities.filter(F.coalesce("name", F.lit("")) != "").select("chunk_id", F.col("name").alias("source")).distinct()
    out = e.join(m, "chunk_id").filter(F.col("source") != F.col("target"))
    return out.select("source", "target", "chunk_id", F.lit("belongs_to").alias("relation"), F.lit(10.0).alias("weight"))


def text_context(chunks: DataFrame, by: str, order: str, text: str = "content", window: int = 1) -> DataFrame:
    """by, order, context: the texts of the neighbours in order, the row itself left out; blank texts don't count as neighbours' text.

    Rows are dealt into ranges of the order that overlap by window, so that no group is ordered in one task.
    """
    size = max(1000, 4 * window)
    part = F.floor(F.col(order) / size)
    said = chunks.select(by, order, text, F.explode(F.array_distinct(F.array(part, F.floor((F.col(order) - window) / size), F.floor((F.col(order) + window) / size)))).alias("part"), part.alias("own"))
    w = Window.partitionBy(by, "part").orderBy(order).rangeBetween(-window, window)
    near = F.filter(F.collect_list(F.struct(F.col(order).alias("i"), F.col(text).alias("t"))).over(w), lambda x: (x["i"] != F.col(order)) & (F.trim(F.coalesce(x["t"], F.lit(""))) != ""))
    out = said.withColumn("near", near).filter(F.col("part") == F.col("own"))
    return out.select(by, order, F.array_join(F.array_sort("near")["t"], "\n").alias("context"))


def source_context(df: DataFrame, hint: str = "auto", window: int = 1) -> DataFrame:
    """The contexts that a source allows: by pages (blocks), by neighbours (chunks), or the text itself; an unknown hint gives empty ones.

    auto chooses by the columns: page_idx and type for blocks, chunk_order_index for chunks, else content or text.
    """
    from spindle.operators.blocks import page_context

    columns = set(df.columns)
    kind = hint if hint != "auto" else "blocks" if {"page_idx", "type", "block_idx"} <= columns else "chunks" if "chunk_order_index" in columns else "text"
    if kind == "blocks":
        return page_context(df, window)
    if kind == "chunks":
        return text_context(df, "full_doc_id", "chunk_order_index", window=window)
    if kind == "text":
        return df.select(F.coalesce(*[F.col(c) for c in ("content", "text") if c in columns], F.lit("")).alias("context"))
    return df.select(F.lit("").alias("context"))


def token_count(text: Column, pattern: str = TOKEN) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def token_head(text: Column, most: int, pattern: str = TOKEN) -> Column:
    """The text up to its token of number most."""
    return F.regexp_extract(text, rf"(?s)^(?:\s*+(?:{pattern})){{0,{most}}}", 0)


def token_truncated(text: Column, most: int, pattern: str = TOKEN) -> Column:
    """Texts of more than most tokens cut at that many, after a stop or before a newline in the last fifth, else with dots."""
    head = token_head(text, most, pattern)
    stop = F.length(head) - F.position(F.lit("."), F.reverse(head))
    line = F.length(head) - F.position(F.lit("\n"), F.reverse(head))
    cut = (
        F.when(head.contains(".") & (stop > F.length(head) * 0.8), head.substr(F.lit(1), stop + 1))
        .when(head.contains("\n") & (line > F.length(head) * 0.8), head.substr(F.lit(1), line)).otherwise(F.concat(head, F.lit("...")))
    )
    return F.when(token_count(text, pattern) <= most, text).otherwise(cut)


def described(items: DataFrame, describe: Callable[[list[str]], list[str]], text: str = "content", key: str = "item_hash") -> DataFrame:
    """key and description by a function of lists of texts, called once a batch in the tasks."""
    import pandas as pd

    def run(frames):
        for f in frames:
            yield pd.DataFrame({key: f[key], "description": describe(f[text].fillna("").tolist())})

    return items.select(key, text).mapInPandas(run, f"{key} {items.schema[key].dataType.simpleString()}, description string")


