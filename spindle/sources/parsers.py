"""Results of outside parsers as blocks: OCR results, document trees, HTML and Markdown; batches of files with what became of each.

Parsers themselves are functions that are given; what they return is read here, a batch of rows at a time.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from spindle.functions.text import suffix_of

#: Keys of an OCR result under which text stands (fixed values).
TEXT_KEYS = ("rec_texts", "text", "texts")
ITEM = "type string, text string, img_path string, table_body string, caption string, page_idx int"
ITEMS = T.ArrayType(T.StructType([*[T.StructField(n, T.StringType()) for n in ("type", "text", "img_path", "table_body", "caption")], T.StructField("page_idx", T.IntegerType())]))


def ocr_texts(node) -> Iterator[str]:
    """All lines of text of an OCR result of any shape, in order, trimmed, none blank; equal ones stay.

    Known shapes are dictionaries with text keys, lists of strings, pairs of a box and (text, score), and (text, score).
    """
    todo = [node]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                yield x.strip()
        elif isinstance(x, dict):
            first = [x[k] for k in TEXT_KEYS if (isinstance(x.get(k), list) if k != "text" else isinstance(x.get(k), str))]
            todo += [v for k, v in x.items() if k not in TEXT_KEYS and v is not None][::-1]
            todo += [y for group in first[::-1] for y in (group[::-1] if isinstance(group, list) else [group])]
        elif isinstance(x, list) and x:
            scored = isinstance(x[0], str) and not all(isinstance(y, str) for y in x) and (len(x) == 1 or isinstance(x[1], (int, float)))
            boxed = len(x) > 1 and isinstance(x[1], list) and x[1] and isinstance(x[1][0], str) and not all(isinstance(y, str) for y in x)
            todo += [x[1][0]] if boxed else [x[0]] if scored else x[::-1]


@F.pandas_udf(T.ArrayType(T.StringType()))
def ocr_lines(result: pd.Series) -> pd.Series:
    """The lines of OCR results in JSON; what isn't JSON is a line itself."""

    def one(t: str | None) -> list[str]:
        try:
            return list(ocr_texts(json.loads(t or "null")))
        except ValueError:
            return [t.strip()] if t and t.strip() else []

    return result.map(one)


def ocr_blocks(results: DataFrame, key: str, result: str, page: str) -> DataFrame:
    """A block of text for each line of each page's result, in order."""
    lines = results.select(key, page, F.posexplode(ocr_lines(F.col(result))).alias("line_no", "text"))
    return lines.select(key, F.col(page).alias("page_idx"), "line_no", F.lit("text").alias("type"), "text")


def tree_items(tree: dict) -> list[dict]:
    """The blocks of a document tree (a body and lists of texts, pictures and tables that refer to one another), in reading order.

    Groups have no block of their own. A tree has no pages: every tenth of what has been counted on
    the way to a block, its siblings before it included, begins a new one.
    """
    out: list[dict] = []
    todo = [(tree.get("body") or {}, "body", "0", 0)]
    while todo:
        block, kind, number, count = todo.pop()
        members = block.get("children") or []
        if not members or kind not in ("groups", "body"):
            count += 1
            out.append(_tree_item(block, kind, number, count // 10))
        later = []
        for i, m in enumerate(members, 1):
            _, name, n = m["$ref"].split("/")[:3]
            later.append((tree[name][int(n)], name, n, count + i))
        todo += later[::-1]
    return out


def _tree_item(block: dict, kind: str, number: str, page: int) -> dict:
    plain = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) if x else ""
    item = dict.fromkeys(("type", "text", "img_path", "table_body", "caption")) | {"page_idx": page}
    if kind == "texts":
        return item | {"type": "equation" if block.get("label") == "formula" else "text", "text": block.get("orig", "")}
    if kind == "pictures":
        if not str((block.get("image") or {}).get("uri", "")).partition(",")[2]:
            return item | {"type": "text", "text": f"[Image processing failed: {plain(block.get('caption', ''))}]"}
        return item | {"type": "image", "img_path": f"images/image_{number}.png", "caption": plain(block.get("caption", ""))}
    return item | {"type": "table", "table_body": plain(block.get("data", [])), "caption": plain(block.get("caption", ""))}


@F.pandas_udf(ITEMS)
def tree_blocks(tree: pd.Series) -> pd.Series:
    """Blocks of document trees in JSON; a tree that can't be read, or has no body, has none."""

    def one(t: str | None) -> list[dict]:
        try:
            x = json.loads(t or "null")
            return tree_items(x) if isinstance(x, dict) and x.get("body") else []
        except (ValueError, KeyError, IndexError, TypeError):
            return []

    return tree.map(one)


def html_blocks(html: Column) -> Column:
    """Headings, paragraphs, list items and cells of HTML as structs of tag and text, in order; tags within are removed, entities of marks resolved."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<(h[1-6]|p|li|td|th)\b[^>]*>.*?</\2\s*>)"), 1)
    clean = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]+>", ""), r"(?U)\s+", " "))

    def entities(x: Column) -> Column:
        for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
            x = F.replace(x, F.lit(a), F.lit(b))
        return x

    out = F.transform(found, lambda x: F.struct(F.lower(F.regexp_extract(x, r"(?i)^<(\w+)", 1)).alias("tag"), entities(clean(x)).alias("text")))
    return F.filter(out, lambda x: x["text"] != "")


def inline_markup(text: Column) -> Column:
    """Inline Markdown as markup: bold, italic, code, links and strike-through; marks of markup in the text are escaped."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    for pattern, to in (
        (r"\*\*(.*?)\*\*", "<b>$1</b>"), (r"__(.*?)__", "<b>$1</b>"), (r"(?U)(?<!\w)\*([^*\n]+?)\*(?!\w)", "<i>$1</i>"), (r"(?U)(?<!\w)_([^_\n]+?)_(?!\w)", "<i>$1</i>"),
        (r"`([^`]+?)`", '<font name="Courier" size="9" color="darkred">$1</font>'), (r"\[([^\]]+?)\]\(([^)]+?)\)", '<link href="$2" color="blue"><u>$1</u></link>'), (r"~~(.*?)~~", "<strike>$1</strike>"),
    ):
        text = F.regexp_replace(text, pattern, to)
    return text


def markdown_blocks(files: DataFrame, text: str = "text") -> DataFrame:
    """file_path, block_idx, type, text, text_level: lines that aren't blank; headings have their level and lose its marks."""
    lines = files.select("file_path", F.posexplode(F.split(text, r"\r?\n")).alias("block_idx", "line")).filter(F.trim("line") != "")
    level = F.length(F.regexp_extract("line", r"^(#{1,6})\s", 1))
    return lines.select("file_path", "block_idx", F.lit("text").alias("type"), F.regexp_replace(F.regexp_replace("line", r"^#{1,6}\s+", ""), r"(?U)^\s+|\s+$", "").alias("text"), F.when(level > 0, level).alias("text_level"))


@F.pandas_udf(T.StringType())
def decoded(content: pd.Series) -> pd.Series:
    """Bytes by the first encoding that they fit: UTF-8, GBK, Windows-1252, else Latin-1, which all fit."""

    def one(raw: bytes | None) -> str | None:
        for name in ("utf-8", "gbk", "cp1252", "latin-1"):
            try:
                return None if raw is None else bytes(raw).decode(name)
            except UnicodeDecodeError:
                pass

    return content.map(one)


OUTCOME = "path string, success boolean, n_blocks int, error string, blocks array<struct<type:string,text:string,page_idx:int>>"


def parse_batch(files: DataFrame, parse: Callable[[str], list[dict]], suffixes: list[str], dry: bool = False) -> DataFrame:
    """path, success, n_blocks, error and blocks of files (path) with a supported suffix; parse runs in the tasks, and what it raises is the error of its file.

    No blocks are an error too. dry calls nothing and takes all as successful.
    """
    wanted = files.filter(suffix_of(F.col("path")).isin(*[s.lower() for s in suffixes])).select("path")
    if dry:
        return wanted.select("path", F.lit(True).alias("success"), F.lit(0).alias("n_blocks"), F.lit("").alias("error"), F.array().cast("array<struct<type:string,text:string,page_idx:int>>").alias("blocks"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path in f["path"]:
                try:
                    blocks = [{"type": b.get("type", "text"), "text": b.get("text"), "page_idx": b.get("page_idx", 0)} for b in parse(path)]
                    out.append((path, bool(blocks), len(blocks), "" if blocks else "no content", blocks))
                except Exception as x:  # noqa: BLE001
                    out.append((path, False, 0, str(x)[:500] or type(x).__name__, []))
            yield pd.DataFrame(out, columns=["path", "success", "n_blocks", "error", "blocks"])

    return wanted.mapInPandas(run, OUTCOME)


def batch_report(outcome: DataFrame) -> DataFrame:
    """One row: files, successes, failures and the success rate in percent, 0 where there are none."""
    n, ok = F.count(F.lit(1)), F.count_if("success")
    return outcome.agg(n.alias("n_files"), ok.alias("n_ok"), (n - ok).alias("n_failed"), F.when(n > 0, F.round(100 * ok / n, 2)).otherwise(0.0).alias("success_rate"))


def batch_blocks(outcome: DataFrame) -> DataFrame:
    """Blocks of the files that were parsed, as they are inserted."""
    return outcome.filter("success").select(F.col("path").alias("file_path"), F.posexplode("blocks").alias("block_idx", "b")).select("file_path", "block_idx", "b.*")


def to_parse(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """Files (file_path) that no content list with blocks stands for yet; parsed has file_path and n_blocks."""
    return files.join(parsed.filter(F.coalesce("n_blocks", F.lit(0)) > 0).select("file_path").distinct(), "file_path", "left_anti")
