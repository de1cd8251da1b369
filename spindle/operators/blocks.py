"""Content blocks: filtering, separation, contexts, chunks and ids.

A block has file_path, block_idx, type, text, text_level, page_idx, img_path and captions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from spindle.functions.ontology import DEFAULT, Ontology
from spindle.functions.predicates import chunk_text
from spindle.functions.text import squeeze, truncated

CAPTIONS = ["image_caption", "table_caption", "image_footnote", "table_footnote"]
#: Pages, or blocks, of a file that are put into context in one task, halos aside.
RANGE = 1000


def drop_reason(o: Ontology = DEFAULT) -> Column:
    """Why a block is noise: type:NAME, pattern:NAME of the first text and pattern that match, or null."""
    kind = F.lower(squeeze(F.col("type")))
    empty = F.array().cast("array<string>")
    captions = [F.coalesce(F.col(c), empty) for c in CAPTIONS]
    own_path = F.when((F.col("type") == "text") & F.col("img_path").isNotNull(), F.array("img_path")).otherwise(empty)
    qr = F.when(F.coalesce("img_path", F.lit("")).rlike("(?i)" + o.qr_path_pattern), F.array(F.lit("QR码"))).otherwise(empty)
    texts = F.concat(F.when(F.col("text").isNotNull(), F.array("text")).otherwise(empty), *captions, own_path, qr)

    def reason(x: Column) -> Column:
        out = F.when(squeeze(x) == "", F.lit(None).cast("string"))
        for name, pattern in o.noise_patterns:
            out = out.when(squeeze(x).rlike("(?i)" + pattern), name)
        return out

    first = F.get(F.filter(F.transform(texts, reason), lambda r: r.isNotNull()), F.lit(0))
    return F.when(kind.isin(*o.noise_types), F.concat(F.lit("type:"), kind)).when(first.isNotNull(), F.concat(F.lit("pattern:"), first))


def filter_blocks(blocks: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    return blocks.filter(drop_reason(o).isNull())


def filter_report(blocks: DataFrame, o: Ontology = DEFAULT) -> DataFrame:
    return blocks.groupBy(F.coalesce(drop_reason(o), F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n_blocks"))


def separate(blocks: DataFrame) -> DataFrame:
    """Per file: its running text (blank texts left out) and how many blocks aren't text; no type counts as text."""
    kind = F.coalesce("type", F.lit("text"))
    said = F.when((kind == "text") & (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)\s+", " ")) != ""), F.struct("block_idx", "text"))
    ordered = F.array_sort(F.collect_list(said))
    return blocks.groupBy("file_path").agg(
        F.array_join(ordered["text"], "\n\n").alias("text"), F.count_if(kind != "text").alias("n_multimodal")
    )


def context_text(headers: bool = True, captions: bool = True) -> Column:
    """A block as context: text under its level, captions of images and tables; else empty."""
    level = F.coalesce("text_level", F.lit(0))
    text = F.coalesce("text", F.lit(""))
    text = F.when((level > 0) & F.lit(headers), F.concat(F.repeat(F.lit("#"), level), F.lit(" "), text)).otherwise(text)
    joined = lambda c: F.array_join(F.col(c), ", ")
    some = lambda c: F.lit(captions) & (F.coalesce(F.size(c), F.lit(0)) > 0)
    return (
        F.when(F.col("type") == "text", text).when((F.col("type") == "image") & some("image_caption"), F.concat(F.lit("[Image: "), joined("image_caption"), F.lit("]")))
        .when((F.col("type") == "table") & some("table_caption"), F.concat(F.lit("[Table: "), joined("table_caption"), F.lit("]"))).otherwise("")
    )


def page_texts(blocks: DataFrame, types: tuple[str, ...] = ("text",)) -> DataFrame:
    """One row a page: its contexts in order. Pages, not blocks, are what windows then run over."""
    said = F.when(F.col("type").isin(*types) & (F.trim("said") != ""), F.struct("block_idx", "said"))
    return blocks.withColumn("said", context_text()).groupBy("file_path", "page_idx").agg(F.array_sort(F.collect_list(said))["said"].alias("said"))


def in_ranges(df: DataFrame, order: str, window: int) -> DataFrame:
    """df with part, the range of the order that a row is of, and own: rows near a bound come in both ranges, once as their own.

    Windows over part see all neighbours that a row of their own has, so that no file is ordered in one task.
    """
    size = max(RANGE, 4 * window)
    at = lambda d: F.floor((F.col(order) + d) / size)
    return df.withColumn("part", F.explode(F.array_distinct(F.array(at(0), at(-window), at(window))))).withColumn("own", F.col("part") == at(0))


def page_context(blocks: DataFrame, window: int = 1, types: tuple[str, ...] = ("text",), most: int | None = None) -> DataFrame:
    """file_path, page_idx, context: texts of the pages up to window away, other pages marked by number."""
    pages = in_ranges(page_texts(blocks, types), "page_idx", window)
    w = Window.partitionBy("file_path", "part").orderBy("page_idx").rangeBetween(-window, window)
    near = F.collect_list(F.struct("page_idx", "said")).over(w)
    mark = lambda p: F.transform(p["said"], lambda s: F.when(p["page_idx"] != F.col("page_idx"), F.concat(F.lit("[Page "), p["page_idx"], F.lit("] "), s)).otherwise(s))
    context = F.array_join(F.flatten(F.transform("near", mark)), "\n")
    return pages.withColumn("near", near).filter("own").select("file_path", "page_idx", (truncated(context, most) if most else context).alias("context"))


def positioned(df: DataFrame, by: str, order: str, tie: str) -> DataFrame:
    """df with position: the number of a row within its group, from 0 on, by counts of ranges of the order and ranks within them."""
    parted = df.withColumn("part", F.floor(F.col(order) / RANGE))
    sizes = parted.groupBy(F.col(by).alias("_by"), F.col("part").alias("_part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_by").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = F.row_number().over(Window.partitionBy(by, "part").orderBy(order, tie))
    same = F.col(by).eqNullSafe(F.col("_by")) & F.col("part").eqNullSafe(F.col("_part"))
    return parted.withColumn("r", r).join(sizes.withColumn("before", before), same).withColumn("position", F.col("before") + F.col("r") - 1).drop("_by", "_part", "part", "n", "before", "r")


def chunk_context(blocks: DataFrame, window: int = 1, types: tuple[str, ...] = ("text",), tie: str = "block_id") -> DataFrame:
    """file_path, block_idx, context: the neighbours in reading order, the block itself left out."""
    said = F.when(F.col("type").isin(*types) & (F.trim(context_text()) != ""), context_text())
    rows = positioned(blocks.select("file_path", "block_idx", tie, said.alias("said")), "file_path", "block_idx", tie)
    base = Window.partitionBy("file_path", "part").orderBy("position")
    before = F.collect_list("said").over(base.rowsBetween(-window, -1))
    after = F.collect_list("said").over(base.rowsBetween(1, window))
    out = in_ranges(rows, "position", window).withColumn("context", F.array_join(F.concat(before, after), "\n"))
    return out.filter("own").select("file_path", "block_idx", "context")


def block_key() -> Column:
    """What a block contributes to the id of its document."""
    some = lambda c: F.coalesce(c, F.lit(""))
    return (
        F.when(F.col("type") == "text", F.trim(some("text"))).when(F.col("type") == "image", F.concat(F.lit("image:"), some("img_path")))
        .when(F.col("type") == "table", F.concat(F.lit("table:"), some("table_body"))).otherwise(F.concat_ws(":", "type", some("text")))
    )


def document_ids(blocks: DataFrame) -> DataFrame:
    """file_path and doc_id, a hash of the hashes of its blocks in order; blank blocks don't count. Only hashes are gathered."""
    key = F.when(block_key() != "", F.struct("block_idx", F.md5(block_key()).alias("k")))
    return blocks.groupBy("file_path").agg(F.concat(F.lit("doc-"), F.md5(F.array_join(F.array_sort(F.collect_list(key))["k"], "\n"))).alias("doc_id"))


def multimodal_chunks(blocks: DataFrame, language: str = "en", description: Column | None = None) -> DataFrame:
    """Chunks of all blocks that aren't text by the template of their type, with an id that is a hash of the content."""
    said = chunk_text(description if description is not None else F.lit(""), language, tuple(blocks.columns))
    return (
        blocks.filter(F.coalesce("type", F.lit("text")) != "text").withColumn("content", said)
        .select(F.concat(F.lit("chunk-"), F.md5("content")).alias("chunk_id"), "file_path", "block_idx", "page_idx", F.col("type").alias("original_type"), "content")
    )
