"""Column functions over names, keys, relations and contexts. All are built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from spindle.functions.ontology import DEFAULT, Ontology

# Forms of suffixes, keys, paths and ends of sentences.
SUFFIX = r"(?i)\s*\((image|table|equation|header|page_number|other)\)\s*$"
CHUNK_ID = r"(?i)\bchunk-[0-9a-f]{32}\b"
IMAGE_PATH = r"(?:Image\s*Path|图片路径)\s*[:：]\s*([^\n\r]*?\.(?:jpg|jpeg|png|gif|bmp|webp|tiff|tif))"
SENTENCE_END = r"(?<=[。！？；;])\s*|\n+"
QUOTE_NOISE = (
    r"(?i)(?:图片路径|Image Path)\s*[:：]\s*\S+\s*",
    r"图片内容分析\s*[:：]\s*",
    r"标注\s*[:：]\s*None\s*",
    r"脚注\s*[:：]\s*None\s*",
)


def any_of(chars: str) -> str:
    """A class of a regular expression that holds these characters."""
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in chars) + "]"


def let(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def squeeze(c: Column) -> Column:
    """White space of any kind to single blanks, none at the ends; null becomes empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def has_cjk(c: Column) -> Column:
    return c.rlike(r"[\x{4e00}-\x{9fff}]")


def has_ascii_word(c: Column) -> Column:
    return c.rlike("[A-Za-z]{2,}")


def without_suffix(c: Column) -> Column:
    return F.regexp_replace(squeeze(c), SUFFIX, "")


def modality_of(name: Column, kind: Column, o: Ontology = DEFAULT) -> Column:
    """The modality a type or the suffix of a name tells; page_number for names of pages; else empty."""
    k, n = F.lower(squeeze(kind)), F.lower(squeeze(name))
    suffix = F.regexp_extract(n, r"\((image|table|equation|header|page_number)\)\s*$", 1)
    return F.when(k.isin(*o.modalities), k).when(suffix != "", suffix).when(n.contains("page ") & n.contains("number"), "page_number").otherwise("")


def split_keys(c: Column, separators: str = "<SEP>") -> Column:
    """Parts of a joined key list: trimmed, not blank, each once in first order. Null gives an empty list."""
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), separators), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def split_keys_loose(c: Column) -> Column:
    """As split_keys, also at semicolons and commas, with escaped separators."""
    return split_keys(F.regexp_replace(c, "&lt;SEP&gt;", "<SEP>"), r"<SEP>|[;,]\s*")


def join_keys(c: Column) -> Column:
    return F.array_join(F.array_distinct(F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: x != "")), "<SEP>")


def safe_int(c: Column) -> Column:
    return F.when(c.cast("string").rlike(r"^\s*[+-]?\d+\s*$"), F.coalesce(F.trim(c.cast("string")).try_cast("bigint"), F.lit(0).cast("bigint"))).otherwise(F.lit(0).cast("bigint"))


def compare_name(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x{4e00}-\x{9fff}A-Za-z0-9]", "")


def entity_type(c: Column, o: Ontology = DEFAULT) -> Column:
    """The type as allowed; modalities become the multimodal type, the rest other."""
    t = squeeze(c)
    return F.when(F.lower(t).isin(*o.modalities), o.multimodal_type).when(t.isin(*o.entity_types), t).otherwise(o.other_type)


def bare(c: Column, o: Ontology = DEFAULT) -> Column:
    """Without marks at the ends."""
    marks = any_of(o.name_marks)
    return F.regexp_replace(c, f"^{marks}+|{marks}+$", "")


def entity_name(c: Column, o: Ontology = DEFAULT) -> Column:
    """A name without suffix of a modality and without marks at its ends; nameless where nothing is left."""
    stripped = bare(squeeze(without_suffix(c)), o)
    return F.when(stripped == "", o.nameless).otherwise(stripped)


def stage_parts(c: Column, o: Ontology = DEFAULT) -> Column:
    """base and stage of a name that ends in a stage of life, bracketed or not; else the name and an empty stage."""
    n = squeeze(c)
    alternatives = "|".join(sorted(o.stages, key=len, reverse=True))
    pattern = rf"^(.+?)[\s\-_/]*[（(【\[]?({alternatives}|{o.stage_pattern})[）)】\]]?$"
    base = bare(F.regexp_extract(n, pattern, 1), o)
    stage = F.regexp_extract(n, pattern, 2)
    hit = (stage != "") & (base != "")
    return F.struct(F.when(hit, base).otherwise(n).alias("base"), F.when(hit, stage).otherwise("").alias("stage"))


def is_plant_part(c: Column, o: Ontology = DEFAULT) -> Column:
    n = squeeze(c)
    return n.isin(*o.plant_parts) | n.endswith(o.part_ending) | ((F.length(n) <= 4) & n.rlike(o.part_letters))


def is_group_name(c: Column, o: Ontology = DEFAULT) -> Column:
    n = squeeze(c)
    listed = n.isin(*o.crop_groups) | _any_word(n, o.group_words)
    return listed | n.rlike(o.taxonomy_pattern) | n.rlike(o.composite_pattern) | ((F.length(n) >= 3) & n.rlike(o.group_pattern))


def routed_type(name: Column, kind: Column, o: Ontology = DEFAULT) -> Column:
    """The type that a name's form demands: parts of plants and groups of crops aren't crops."""
    return (
        F.when(kind.isin(*o.protected_types), kind).when(is_plant_part(name, o), "部位")
        .when(kind.isin("作物", "生物分类", "其他") & is_group_name(name, o), "生物分类").otherwise(kind)
    )


def consistent_type(name: Column, kind: Column, o: Ontology = DEFAULT) -> Column:
    """Allowed type of a normalised name: names that aren't in the canonical language are other, then the routing."""
    t, n = entity_type(kind, o), entity_name(name, o)
    foreign = ~has_cjk(n) & has_ascii_word(n) & ~t.isin(o.other_type, o.multimodal_type, *o.attribute_fields)
    t = F.when(F.lit(o.canonical_language == "zh") & foreign, o.other_type).otherwise(t)
    return routed_type(n, t, o)


def _any_word(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))  # one expression: it is copied wherever a filter on it is pushed down


def relation_of(keywords: Column, description: Column, o: Ontology = DEFAULT) -> Column:
    """The relation named by the first word list that has a word in the text; empty if none has."""
    text = F.lower(F.concat(F.coalesce(keywords, F.lit("")), F.lit(" "), F.coalesce(description, F.lit(""))))
    out = F.when(F.lit(False), "")
    for relation, words in o.relation_words:
        out = out.when(_any_word(text, words), relation)
    return out.otherwise("")


def relation_allowed(relation: Column, source: Column, target: Column, o: Ontology = DEFAULT) -> Column:
    """Whether types may be so related; unknown types may, relations without listed pairs too."""
    pair = F.concat_ws("/", relation, source, target)
    listed = sorted({p[0] for p in o.pairs})
    return (
        F.when(relation == o.always_allowed, True).when(relation == "", False).when((source == "") | (target == ""), True)
        .when(~relation.isin(*o.relations), False).when(~relation.isin(*listed), True).otherwise(pair.isin(*["/".join(p) for p in o.pairs]))
    )


def is_alias(keywords: Column, description: Column, o: Ontology = DEFAULT) -> Column:
    return _any_word(F.lower(F.concat_ws(" ", keywords, description)), o.alias_words)


def attribute_field(relation: Column, keywords: Column, description: Column, o: Ontology = DEFAULT) -> Column:
    text = F.lower(F.concat_ws(" ", F.coalesce(relation, F.lit("")), F.coalesce(keywords, F.lit("")), F.coalesce(description, F.lit(""))))
    out = F.when(F.lit(False), "")
    for name, words in o.attribute_words:
        out = out.when(_any_word(text, words), name)
    return out.otherwise("")


def attribute_value(name: Column, node_description: Column, edge_description: Column) -> Column:
    """The description of node or edge, if not shorter than the name; else the name."""
    a, b = squeeze(node_description), squeeze(edge_description)
    long = lambda x: (x != "") & (F.length(x) >= F.length(name))
    return F.when(long(a), a).when(long(b), b).otherwise(name)


def bigrams(c: Column) -> Column:
    """Character pairs of a text; its characters where it is shorter."""
    pairs = F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: c.substr(i, F.lit(2)))
    return F.when(F.length(c) >= 2, pairs).when(F.length(c) == 1, F.array(c)).otherwise(F.array().cast("array<string>"))


def bigram_cosine(a: Column, b: Column) -> Column:
    """Cosine of the bigram counts; 0 where either is empty."""
    count = lambda xs, g: F.size(F.filter(xs, lambda h: h == g))
    dot = lambda x, y: F.aggregate(F.array_distinct(x), F.lit(0.0), lambda s, g: s + count(x, g) * count(y, g))
    both = lambda v: F.when((F.size(v["x"]) == 0) | (F.size(v["y"]) == 0), 0.0).otherwise(dot(v["x"], v["y"]) / F.sqrt(dot(v["x"], v["x"]) * dot(v["y"], v["y"])))
    return let(F.struct(bigrams(a).alias("x"), bigrams(b).alias("y")), both)


def sentences(c: Column) -> Column:
    """Sentences of Chinese text, trimmed, none blank; the whole where there is none."""

    def split(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, SENTENCE_END), lambda x: F.trim(x)), lambda x: x != "")
        return let(parts, lambda p: F.when(F.size(p) > 0, p).otherwise(F.array(F.trim(t))))

    return let(c, split)


def quote_source(c: Column) -> Column:
    """Chunk content without image path, label of an analysis and empty captions."""
    t = squeeze(c)
    for p in QUOTE_NOISE:
        t = F.regexp_replace(t, p, "")
    return F.trim(t)


def around(text: Column, terms: Column, most: int) -> Column:
    """At most so many characters: the window in which the first term stands a third of the way in, moved back at the end of the text; dots mark cuts."""
    first = F.array_min(F.filter(F.transform(terms, lambda t: F.position(t, text)), lambda p: p > 0))
    begin = F.least(F.greatest(first - 1 - most // 3, F.lit(0)), F.length(text) - most)
    window = F.trim(F.substring(text, begin + 1, F.lit(most)))
    dots = lambda cond: F.when(cond, "...").otherwise("")
    found = F.concat(dots(begin > 0), window, dots(begin + most < F.length(text)))
    return F.when(F.length(text) <= most, text).when(first.isNull(), F.rtrim(F.substring(text, 1, most))).otherwise(found)


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, cut after a stop or before a newline in the last fifth, else with dots."""
    head = text.substr(1, most)
    stop = F.length(head) - F.position(F.lit("."), F.reverse(head))
    line = F.length(head) - F.position(F.lit("\n"), F.reverse(head))
    has = lambda mark: head.contains(mark)
    return (
        F.when(F.length(text) <= most, text).when(has(".") & (stop > F.length(head) * 0.8), head.substr(F.lit(1), stop + 1))
        .when(has("\n") & (line > F.length(head) * 0.8), head.substr(F.lit(1), line)).otherwise(F.concat(head, F.lit("...")))
    )


def chunk_ids(c: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(CHUNK_ID), 0), lambda x: F.lower(x)))


def image_paths(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(c, F.lit("(?i)" + IMAGE_PATH), 1))


def clamped(c: Column, low: int = 1, high: int = 5, default: int = 3) -> Column:
    return F.least(F.greatest(F.coalesce(c.try_cast("int"), F.lit(default)), F.lit(low)), F.lit(high))


def file_name(c: Column) -> Column:
    return F.element_at(F.split(c, r"[/\\]"), -1)


def suffix_of(c: Column) -> Column:
    return F.lower(F.regexp_extract(c, r"(\.[^./\\]+)$", 1))
