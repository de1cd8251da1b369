"""Tests of blocks, descriptions, images and files, and the texts made of them. All are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from spindle.functions.ontology import DEFAULT, Ontology
from spindle.functions.text import file_name, image_paths, squeeze, suffix_of

LISTED = ("image_caption", "table_caption", "image_footnote", "table_footnote")
#: Descriptions that say nothing (fixed values).
EMPTY_TEXTS = ("n/a", "none", "null", "{}")
MOST_IMAGE_BYTES = 50 * 1024 * 1024
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".webp", ".tiff", ".tif")
UPLOAD_SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".bmp", ".tiff", ".tif", ".gif", ".webp", ".doc", ".docx", ".ppt", ".pptx", ".xls", ".xlsx", ".txt", ".md")

# Templates by type and language; {0} stands for the description.
TEMPLATES = {
    ("image", "en"): "\nImage Content Analysis:\nImage Path: {img_path}\nCaptions: {image_caption}\nFootnotes: {image_footnote}\n\nVisual Analysis: {0}",
    ("table", "en"): "Table Analysis:\nImage Path: {img_path}\nCaption: {table_caption}\nStructure: {table_body}\nFootnotes: {table_footnote}\n\nAnalysis: {0}",
    ("equation", "en"): "Mathematical Equation Analysis:\nEquation: {text}\nFormat: {text_format}\n\nMathematical Analysis: {0}",
    ("generic", "en"): "{type} Content Analysis:\nContent: {content}\n\nAnalysis: {0}",
    ("image", "zh"): "\n图片内容分析：\n图片路径：{img_path}\n标注：{image_caption}\n脚注：{image_footnote}\n\n视觉分析：{0}",
    ("table", "zh"): "表格分析：\n图片路径：{img_path}\n标题：{table_caption}\n结构：{table_body}\n脚注：{table_footnote}\n\n分析：{0}",
    ("equation", "zh"): "数学公式分析：\n公式：{text}\n格式：{text_format}\n\n数学分析：{0}",
    ("generic", "zh"): "{type}内容分析：\n内容：{content}\n\n分析：{0}",
}


def _some(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def _texts(c: str) -> Column:
    return F.coalesce(F.col(c), F.array().cast("array<string>"))


def stripped(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def qr_like(o: Ontology = DEFAULT) -> Column:
    """Whether path, text, captions or footnotes of a block speak of a code to scan."""
    shown = F.array_join(F.concat(*[_texts(c) for c in LISTED]), " ")
    return F.concat_ws(" ", "img_path", "text", shown).rlike("(?i)" + o.qr_pattern)


def unfenced(c: Column) -> Column:
    """Trimmed, without the fence of a code block."""
    t = F.regexp_replace(_some(c), r"(?U)^\s+|\s+$", "")
    return F.when(t.startswith("```"), F.regexp_replace(F.regexp_replace(t, r"(?i)^```(?:json)?\s*", ""), r"\s*```$", "")).otherwise(t)


def marker(c: Column, name: str) -> Column:
    """What a description, JSON or nearly so, has as detailed_description or summary; empty if nothing."""
    path = {"detailed_description": "$.detailed_description", "summary": "$.entity_info.summary"}[name]
    by_pattern = F.regexp_extract(_some(c), rf'(?s)"{name}"\s*:\s*"([^"]*(?:\\.[^"]*)*)"', 1)
    return squeeze(F.coalesce(F.get_json_object(unfenced(c), path), by_pattern))


def empty_description(text: Column, summary: Column) -> Column:
    """Whether a description says nothing: blank, a word for nothing, or JSON whose fields are blank, and no summary either."""
    t, s = squeeze(text), squeeze(summary)
    structured = F.lit(False)
    for name in ("detailed_description", "entity_info", "summary"):
        structured = structured | _some(text).contains(f'"{name}"')
    blank = (marker(text, "detailed_description") == "") & (marker(text, "summary") == "")
    return ((s == "") & ((t == "") | F.lower(t).isin(*EMPTY_TEXTS))) | (structured & blank)


def empty_result(description: Column, summary: Column) -> Column:
    """Whether what a model gave for an item is empty: both blank, or JSON with both blank."""
    d = F.regexp_replace(_some(description), r"(?U)^\s+|\s+$", "")
    both = (d == "") & (F.trim(_some(summary)) == "")
    is_object = F.json_object_keys(unfenced(description)).isNotNull()
    told = lambda p: F.trim(_some(F.get_json_object(unfenced(description), p)))
    parsed = is_object & (told("$.detailed_description") == "") & (told("$.entity_info.summary") == "")
    return both | F.coalesce(parsed, F.lit(False)) | unfenced(description).rlike(r'(?is)"detailed_description"\s*:\s*"".*"summary"\s*:\s*""')


def needs_retry(description: Column, summary: Column, least: int = 80, o: Ontology = DEFAULT) -> Column:
    """Whether a description is worth asking for again: not of a code, not empty, but shorter than least characters."""
    if least <= 0:
        return F.lit(False)
    short = F.length(F.regexp_replace(_some(description), r"(?U)^\s+|\s+$", "")) < least
    return ~qr_like(o) & ~empty_result(description, summary) & short


def image_noise(path: Column, n_bytes: Column, metadata: Column, blank: Column | None = None, o: Ontology = DEFAULT) -> Column:
    """Why an image isn't worth describing, the first reason that applies, or null; n_bytes is null where there is no file."""
    told = F.trim(F.concat_ws(" ", F.when(_some(metadata) != "", metadata), file_name(path)))
    noise = F.lit(False)
    for p in o.image_noise_patterns:
        noise = noise | told.rlike("(?i)" + p)
    out = F.when(n_bytes.isNull(), "missing_image_file").when(n_bytes <= 0, "empty_image_file").when(noise, "noise_metadata")
    out = out.when((_some(metadata) != "") & metadata.rlike("(?i)" + o.path_only_pattern), "path_only_metadata")
    return out.when(blank, "blank_image") if blank is not None else out


def valid_image(path: Column, n_bytes: Column, symlink: Column | None = None, most: int = MOST_IMAGE_BYTES) -> Column:
    """Whether an image file exists (its size is known), is no link, has a known suffix and isn't too large."""
    ok = F.coalesce((n_bytes >= 0) & (n_bytes <= most), F.lit(False)) & F.coalesce(suffix_of(path).isin(*IMAGE_SUFFIXES), F.lit(False))
    return ok & ~F.coalesce(symlink, F.lit(False)) if symlink is not None else ok


def normal_path(path: Column) -> Column:
    """Without steps back and forth: . and .. resolved, single slashes; .. at the root stays there."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    kept = F.aggregate(
        F.filter(parts, lambda x: ~x.isin("", ".")), F.array().cast("array<string>"),
        lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.array_append(acc, x)),
    )
    return F.concat(F.when(F.translate(path, "\\", "/").startswith("/"), "/").otherwise(""), F.array_join(kept, "/"))


def within(path: Column, folders: list[str]) -> Column:
    """Whether a path lies in one of the folders once .. is resolved."""
    p, out = normal_path(path), F.lit(False)
    for f in folders:
        f = f.rstrip("/")
        out = out | (p == f) | p.startswith(f + "/")
    return F.coalesce(out, F.lit(False))


def upload_verdict(name: Column, n_bytes: Column, taken: Column) -> Column:
    """suffix or empty for uploads that are refused, renamed for names already taken, else accepted."""
    refused = F.when(~F.coalesce(suffix_of(name).isin(*UPLOAD_SUFFIXES), F.lit(False)), "suffix").when(F.coalesce(n_bytes, F.lit(0)) <= 0, "empty")
    return refused.when(taken, "renamed").otherwise("accepted")


def upload_name(name: Column, taken: Column, salt: Column) -> Column:
    """The name a file is stored under: with six digits of a hash before the suffix where it is taken."""
    stem = F.regexp_replace(file_name(name), r"\.[^./\\]+$", "")
    suffix = F.regexp_extract(file_name(name), r"(\.[^./\\]+)$", 1)
    return F.when(taken, F.concat(stem, F.lit("_"), F.substring(F.md5(salt), 1, 6), suffix)).otherwise(file_name(name))


def chunk_kind(content: Column) -> Column:
    """modality, image_path, table_html and equation_text that the text of a chunk tells by its first line."""
    t = _some(content)
    first_image = F.coalesce(F.get(image_paths(t), F.lit(0)), F.lit(""))
    has = lambda *words: F.coalesce(t.contains(words[0]) | t.contains(words[1]), F.lit(False))
    image, grid, equation = has("图片内容分析", "Image Content Analysis"), has("表格分析", "Table Analysis"), has("数学公式分析", "Mathematical Equation Analysis")
    modality = F.when(image, "image").when(grid, "table").when(equation, "equation").otherwise("text")
    html = F.regexp_replace(F.regexp_extract(t, r"(?s)(?:结构|Structure)[:：](.*)", 1), r"(?U)^\s+|\s+$", "")
    return F.struct(
        modality.alias("modality"), F.when(modality.isin("image", "table"), first_image).otherwise("").alias("image_path"),
        F.when(modality == "table", html).otherwise("").alias("table_html"), F.when(modality == "equation", F.substring(t, 1, 1200)).otherwise("").alias("equation_text"),
    )


def chunk_text(description: Column, language: str = "en", columns: tuple[str, ...] = ()) -> Column:
    """A block as a chunk by the template of its type: image, table, equation, or the generic one under the name of the type.

    columns names the columns that there are; what a template needs beyond them is empty. Empty
    lists of captions become None. Content of the generic template is content, else text.
    """
    has = lambda c: c in columns
    listed = lambda c: F.when(F.coalesce(F.size(F.col(c)), F.lit(0)) <= 0, "None").otherwise(F.array_join(F.col(c), ", ")) if has(c) else F.lit("None")
    plain = lambda c: _some(F.col(c)) if has(c) else F.lit("")
    content = F.coalesce(*([F.col("content")] if has("content") else []), F.col("text"), F.lit(""))
    values = {c: listed(c) for c in LISTED} | {c: plain(c) for c in ("img_path", "table_body", "text", "text_format")} | {"type": F.initcap(F.col("type")), "content": content, "0": _some(description)}

    def filled(kind: str) -> Column:
        parts, rest = [], TEMPLATES[kind, language]
        while "{" in rest:
            before, _, rest = rest.partition("{")
            name, _, rest = rest.partition("}")
            parts += [F.lit(before), values[name]]
        return F.concat(*parts, F.lit(rest))

    kind = F.col("type")
    return F.when(kind == "image", filled("image")).when(kind == "table", filled("table")).when(kind == "equation", filled("equation")).otherwise(filled("generic"))


def entity_text(name: Column, kind: Column, summary: Column, aliases: Column, attributes: Column, modality: Column) -> Column:
    """What is embedded of an entity: a line each for name, type, description, aliases, attributes and modality; blank ones left out.

    aliases is a list; attributes maps fields to lists of values. Items are joined by a wide semicolon.
    """
    items = lambda c: F.array_join(F.filter(F.transform(c, stripped), lambda x: x != ""), "；")
    pairs = F.transform(F.map_entries(attributes), lambda e: F.when(items(e["value"]) != "", F.concat(e["key"], F.lit(":"), items(e["value"]))))
    line = lambda label, c: F.when(_some(stripped(c)) != "", F.concat(F.lit(label), stripped(c)))
    return F.concat_ws(
        "\n", F.concat(F.lit("实体:"), name), line("类型:", kind), line("描述:", summary), line("别名:", items(aliases)),
        line("属性:", F.array_join(F.filter(pairs, lambda x: x.isNotNull()), "；")), line("模态:", modality),
    )


def label_terms(texts: list[Column], lists: list[Column]) -> Column:
    """All labels of an item, single ones and lists, trimmed, each once, none blank."""
    flat = F.concat(F.array(*texts), *[F.coalesce(x, F.array().cast("array<string>")) for x in lists])
    return F.array_distinct(F.filter(F.transform(flat, lambda x: F.trim(x)), lambda x: x != ""))
