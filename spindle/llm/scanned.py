"""Noise in text from scanned pages: found per block, and repaired into continuous text.

Edge lines that repeat the page's furniture are matched with the titles of the file (and, in
files without header blocks, of the corpus) within one edit, by an equi-join on halves, of which
one edit leaves one as it is. Words split at line ends are told from broken compounds by how often
the corpus has the joined and the hyphenated form. Misread words are found by anagram hashes:
the hash of a word is the sum of a power of its character codes, so that a confusion of look-
alikes shifts it by a fixed difference, and rare words join their frequent variants on equal
shifted hashes, which are then verified and ranked. Letters read in numbers are found likewise by
the shapes of numbers. Misread Chinese characters are found by what stands around them: a rare
window joins the frequent ones that differ from it in one character.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations_with_replacement

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from spindle.session import written

# What is printed, and what it is misread as.
LATIN_CONFUSIONS = "e:c o:0 i:1 l:1 s:5 h:b b:8 m:rn rn:m h:8 w:vv l:i i:l g:9 b:6 z:2".split()
HAN_CONFUSIONS = (
    "叶吐 菜莱 害宫 斑班 株抹 菌茵 土士 茎荃 治冶 收牧 霉莓 幼幻 蛾娥 枯桔 蜂峰 壤攘 "
    "未末 己已 日曰 入人 天夭 干千 根恨 侵浸 施旋 粒拉 液夜 病痛 虫虽 花化 螨蹒 蝽春 防妨 喷愤 剂济 氮氨 晴睛 温湿 洲州 治诒 田由 果杲 卵卯 籽仔 秆杆 苗笛 茄笳"
).split()
#: Errors of a word up to which differences of hashes are listed (words with more are joined as folded); how many times as frequent a variant must be, for words of letters and for words with digits.
MOST_ERRORS, RATIO, RATIO_MIXED, LEAST = 3, 8, 2, 3
#: Part of a character's occurrences that must look like another's for a pair that isn't listed.
SUPPORT = 0.5
POWER = 5
#: Bits of the filter by which contexts without an error are left out early, as a power of two; texts whose contexts are made at once.
FILTER_BITS, AT_ONCE = 24, 2_000_000
HAN_RANGES = ((0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))
HAN = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}\x{20000}-\x{3ffff}]"
MARKS = r"[\s\p{Z}()\[\]（）【】〔〕〈〉<>«»=_:：~～*|/※•·.,，。．…\-‐‑‒–—―−]"
HYPHEN = r"[-‐‑¬\x{ad}⁃﹣－]"
WORD = r"[A-Za-z0-9]+"
#: Shapes of numbers that any corpus has (fixed values); others must be frequent in this one.
SHAPES = ("0", "00", "000", "0000", "0.0", "00.0", "0.00", "000.0")
NUMBER = r"(?<![A-Za-z0-9])[0-9]+(?:\.[0-9]+)?(?![A-Za-z0-9])"
DIGITS_READ = r"(?<![A-Za-z0-9])(?:[0-9]+[OolI][0-9OolI]*(?:\.[0-9OolI]+)?|[OolI]+[0-9][0-9OolI]*(?:\.[0-9OolI]+)?|[0-9]+\.[0-9]*[OolI][0-9OolI]*)(?![A-Za-z0-9])"
LETTERS_READ = r"(?<=[\p{IsHan}～~±])[lIO]{1,3}(?=[\p{IsHan}%℃～~.])|(?<=[A-Za-z0-9,] )(?:l|[lI]?O{1,3})(?=[\s%℃,;.])(?! ?[A-Z])(?! +\p{L}(?:\s|$))(?<!(?:^|\s)\p{L} .)"


def folded(word: Column) -> Column:
    """Look-alikes replaced by one of them: words that differ by confusions alone fold alike."""
    w = F.replace(F.replace(word, F.lit("rn"), F.lit("m")), F.lit("vv"), F.lit("w"))
    return F.translate(w, "c01l58h692z", "eoiisbbbgzz")


def anagram_hash(word: Column, power: int) -> Column:
    """The sum of a power of the character codes."""
    return F.aggregate(F.split(word, "(?!^)(?=.)"), F.lit(0).cast("long"), lambda a, c: a + F.pow(F.ascii(c).cast("double"), power).cast("long"))


def _value(chars: str, power: int) -> int:
    return sum(int(float(ord(c)) ** power) for c in chars)


def records(df: DataFrame) -> DataFrame:
    """One row per block as first taken in; rows with a null key hold no block."""
    fields = ["file_path", "page_idx", "type", "text", "image_caption"]
    return (
        df.filter(F.col("block_id").isNotNull()).select("block_id", "ingested_at", *fields)
        .groupBy("block_id").agg(F.min(F.struct("ingested_at", *fields)).alias("r")).select("block_id", *[f"r.{f}" for f in fields])
    )


def lines_of(blocks: DataFrame) -> DataFrame:
    """The lines of text blocks (unit 0) and of the elements of image captions (units from 0 on)."""
    units = F.when(F.col("type") == "text", F.array("text")).when(F.col("type") == "image", F.col("image_caption"))
    return (
        blocks.select("block_id", "file_path", "page_idx", "type", F.posexplode(units).alias("unit", "text")).filter(F.col("text").isNotNull())
        .select("block_id", "file_path", "page_idx", "type", "unit", F.posexplode(F.split("text", r"\r?\n|\r")).alias("line_no", "line"))
    )


def narrow(c: Column) -> Column:
    wide = "".join(map(chr, range(0xFF01, 0xFF5F))) + "　"
    return F.translate(c, wide, "".join(chr(ord(x) - 0xFEE0) for x in wide[:-1]) + " ")


def title_core(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), r"[^\p{L}]+", "")


def like_title(flat: Column) -> Column:
    """No mark of a sentence; Latin words mostly begin with capitals, or are letters set apart."""
    words = F.regexp_count(flat, F.lit(r"(?<![\p{L}’'])\p{IsLatin}"))
    capitals = F.regexp_count(flat, F.lit(r"(?<![\p{L}’'])\p{Lu}"))
    return ~flat.rlike(r"[，。；：！？、,;:!?]|\.\s|\.$") & ((words == 0) | (capitals * 10 >= words * 6) | flat.rlike(r"^\W*(?:\p{L}\s+){4}"))


def halves(core: Column, length: Column) -> Column:
    """The two halves of a string of that length, each with its side and the length, as hashes.

    A string within one edit of it begins with the first half or ends with the second. Strings of
    less than four characters have no edit to spare and must be equal.
    """
    half = F.floor(length / 2).cast("int")
    side = lambda mark, part: F.xxhash64(F.lit(mark), length, part)
    return F.when(length < 4, F.array(side("all", core))).otherwise(
        F.array(side("begin", F.substring(core, F.lit(1), half)), side("end", F.substring(core, F.length(core) - (length - half) + 1, length - half)))
    )


def near_halves(core: Column) -> Column:
    """The halves that strings within one edit of this one may share with it."""
    n = F.length(core)
    return F.array_distinct(F.flatten(F.transform(F.filter(F.array(n - 1, n, n + 1), lambda x: (x > 0) & ((x >= 4) | (x == n))), lambda x: halves(core, x))))


def within_edit(core: str, title: str) -> Column:
    return F.levenshtein(core, title) <= F.when(F.length(title) < 4, 0).otherwise(1)


def page_offsets(blocks: DataFrame) -> DataFrame:
    """file_path, offset: printed page number minus page index, as most page_number blocks of the file have it."""
    n = F.expr(r"try_cast(regexp_extract(t, '(\\d{1,6})', 1) as int)")
    return (
        blocks.filter(F.col("type") == "page_number").withColumn("t", narrow(F.col("text")))
        .select("file_path", (n - F.col("page_idx")).alias("offset")).filter(F.col("offset").isNotNull())
        .groupBy("file_path", "offset").agg(F.count(F.lit(1)).alias("n"))
        .groupBy("file_path").agg(F.max(F.struct("n", F.col("offset").alias("o")))["o"].alias("offset"))
    )


def furniture(blocks: DataFrame, lines: DataFrame, name: str = "scans") -> DataFrame:
    """Lines with is_header and is_page added."""
    # narrow characters once: three branches read them
    marked = written(lines.withColumn("flat", F.trim(narrow(F.col("line")))).withColumn("core", title_core(F.col("flat"))), f"{name}-marked")
    titles = (
        blocks.filter((F.col("type") == "header") & F.col("text").isNotNull())
        .select("file_path", title_core(narrow(F.col("text"))).alias("title")).filter(F.col("title") != "").distinct()
    )
    have = titles.select("file_path").distinct().withColumn("has", F.lit(True))
    # a file without header blocks has the titles of others, and what its own pages repeat in the form of a title
    again = (
        marked.join(have, "file_path", "left_anti").filter((F.col("type") == "text") & (F.length("core") >= 6) & like_title(F.col("flat")))
        .groupBy("file_path", "core").agg(F.countDistinct("page_idx").alias("pages")).filter(F.col("pages") > 1).select("file_path", F.col("core").alias("title"))
    )
    everywhere = titles.filter(F.length("title") >= 4).select(F.lit(None).cast("string").alias("file_path"), "title").distinct()
    known = written(titles.unionByName(again).unionByName(everywhere), f"{name}-titles")
    longest = known.agg(F.coalesce(F.max(F.length("title")), F.lit(0))).first()[0]
    # a line is looked up once for each core, under its file and, where that has no header blocks, under none; a core that is longer than any title by more than an edit is none
    asked = marked.filter((F.col("core") != "") & (F.length("core") <= longest + 1)).select("file_path", "core").distinct().join(have, "file_path", "left")
    under = F.when(F.col("has").isNull(), F.array("file_path", F.lit(None).cast("string"))).otherwise(F.array("file_path"))
    key = F.xxhash64("under", "half").alias("key")
    asked = asked.withColumn("under", F.explode(under)).withColumn("half", F.explode(near_halves(F.col("core")))).select("file_path", "core", key)
    known = known.withColumn("half", F.explode(halves(F.col("title"), F.length("title")))).select("title", F.xxhash64("file_path", "half").alias("key"))
    found = asked.join(known, "key")
    # written, so that their sizes are known when the lines are joined to them
    hits = written(found.filter(within_edit("core", "title")).select("file_path", "core").distinct().withColumn("is_header", F.lit(True)), f"{name}-headers")
    offsets = written(page_offsets(blocks), f"{name}-offsets")
    number = F.coalesce(
        *[F.expr(f"try_cast(nullif(regexp_extract(flat, r'{p}', 1), '') as int)") for p in (
            rf"(?i)^{MARKS}*(?:page|pag|pg|p|第)?{MARKS}*(\d{{1,5}}){MARKS}*(?:页|頁)?{MARKS}*$",
        )]
    )
    beside = F.col("flat").rlike(rf"^{MARKS}*\d{{1,5}}{MARKS}+\D|\D{MARKS}+\d{{1,5}}{MARKS}*$|\D\d{{1,5}}$|^\d{{1,5}}\D")
    fits = F.col("offset").isNull() | (F.col("page_idx") + F.col("offset") == number)
    return (
        marked.join(hits, ["file_path", "core"], "left").join(offsets, "file_path", "left")
        .withColumn("is_header", F.coalesce("is_header", F.lit(False)))
        .withColumn("is_page", F.when(F.col("is_header"), beside).otherwise(F.coalesce(number.isNotNull() & fits & ~F.col("flat").rlike(r"\d[.,]\d|\d\.$"), F.lit(False))))
        .select("block_id", "unit", "line_no", "line", "is_header", "is_page")
    )


def running_units(lines: DataFrame) -> DataFrame:
    """block_id, unit, lines: the running lines of a unit in order, without white space at their ends; blank ones between others stay."""
    line = F.regexp_replace("line", r"(?U)[\s\p{Cc}]+$", "")
    ordered = F.array_sort(F.collect_list(F.struct("line_no", line.alias("line"))))["line"]
    return lines.groupBy("block_id", "unit").agg(ordered.alias("lines"))


def line_breaks(units: DataFrame) -> DataFrame:
    """block_id, unit, at, a, b, hard: lines (numbered from 0) that end in a hyphen, with the word before it and the one that the next line begins with."""
    pairs = F.transform(
        F.filter(F.sequence(F.lit(0), F.size("lines") - 2), lambda i: F.get("lines", i).rlike(rf"[A-Za-z0-9]{HYPHEN}$")),
        lambda i: F.struct(i.cast("int").alias("at"), F.get("lines", i).alias("line"), F.get("lines", i + 1).alias("next")),
    )
    cut = units.filter(F.size("lines") > 1).select("block_id", "unit", F.explode(pairs).alias("p")).select("block_id", "unit", "p.*")
    left = F.regexp_extract("line", rf"([A-Za-z0-9]*[A-Za-z][A-Za-z0-9]*){HYPHEN}$", 1)
    right = F.regexp_extract(F.regexp_replace("next", r"(?U)^[\s\p{Cc}&&[^\x{ad}]]+", ""), r"^([A-Za-z0-9]+)", 1)
    hard = F.col("line").rlike(r"[¬\x{ad}]$")
    return cut.select("block_id", "unit", "at", F.lower(left).alias("a"), F.lower(right).alias("b"), hard.alias("hard")).filter((F.col("a") != "") & (F.col("b") != ""))


def broken_words(units: DataFrame, name: str = "scans") -> DataFrame:
    """block_id, unit, at, broken: breaks at a hyphen, told apart by how often the corpus has the whole word and the compound within its lines."""
    cut = written(line_breaks(units), f"{name}-breaks")
    # words and compounds as they stand within lines
    inner = F.transform("lines", lambda x: F.when(x.rlike("[A-Za-z0-9]"), F.regexp_replace(F.lower(x), rf"{WORD}{HYPHEN}$", "")))
    spread = units.select(F.explode(inner).alias("line")).filter(F.col("line").isNotNull())
    seen = spread.select(F.explode(F.regexp_extract_all("line", F.lit(rf"({WORD}(?:[-‐‑]{WORD})?)"), 1)).alias("word")).select(F.translate("word", "‐‑", "--").alias("word"))
    seen = seen.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    asked = cut.select("a", "b").distinct().select("a", "b", F.explode(F.array(
        F.struct(F.concat("a", "b").alias("word"), F.lit(1).alias("k")), F.struct(F.concat_ws("-", "a", "b").alias("word"), F.lit(2).alias("k")),
    )).alias("x")).select("a", "b", "x.*")
    n = lambda k: F.max(F.when(F.col("k") == k, F.coalesce("n", F.lit(0))))
    evidence = asked.join(seen, "word", "left").groupBy("a", "b").agg(n(1).alias("whole"), n(2).alias("parts"))
    return cut.join(evidence, ["a", "b"]).select("block_id", "unit", "at", (F.col("hard") | (F.col("whole") >= F.col("parts"))).alias("broken"))


def unit_texts(units: DataFrame, breaks: DataFrame) -> DataFrame:
    """block_id, unit, text: the lines joined to running text; what stands at a hyphen is closed up, blank lines part paragraphs."""
    at = breaks.groupBy("block_id", "unit").agg(F.map_from_entries(F.collect_list(F.struct("at", "broken"))).alias("breaks"))
    wide_end = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}，。、；：！？）”’》」\d]$"
    wide_begin = r"^[\p{IsHan}\p{IsHiragana}\p{IsKatakana}，。、；：！？（“‘《「\d]"

    def piece(line: Column, i: Column) -> Column:
        broken = F.try_element_at("breaks", i)  # null where no hyphen is in question
        after = F.regexp_replace(F.get("lines", i + 1), r"(?U)^\s+", "")
        close = broken.isNotNull() | (line.rlike(wide_end) & after.rlike(wide_begin))
        sep = F.when((line == "") | after.isNull(), "").when(after == "", "\n\n").when(F.coalesce(close, F.lit(False)), "").otherwise(" ")
        text = F.when(broken, F.regexp_replace(line, rf"{HYPHEN}$", "")).otherwise(line)
        return F.concat(F.regexp_replace(text, r"(?U)^\s+", ""), sep)

    joined = F.when(F.size("lines") == 1, F.regexp_replace(F.get("lines", F.lit(0)), r"(?U)^\s+", "")).otherwise(F.array_join(F.transform("lines", piece), ""))
    return units.join(at, ["block_id", "unit"], "left").select("block_id", "unit", F.rtrim(joined, F.lit(" \n")).alias("text"))


def latin_corrections(words: DataFrame) -> DataFrame:
    """word, correct: each misread word with the most frequent of its variants; words has word and n, lower case."""
    pairs = [tuple(c.split(":")) for c in LATIN_CONFUSIONS]
    shifts = []
    for k in range(1, MOST_ERRORS + 1):
        for chosen in combinations_with_replacement(pairs, k):
            shift = sum(_value(s, POWER) - _value(t, POWER) for t, s in chosen)
            shifts.append((shift, "".join(sorted({c for _, s in chosen for c in s})), k))
    table = words.sparkSession.createDataFrame(shifts, "shift long, needs string, errors int")
    table = table.groupBy("shift", "needs").agg(F.min("errors").alias("errors"))
    hashed = words.filter(F.length("word") >= 2).withColumn("h", anagram_hash(F.col("word"), POWER))
    frequent = hashed.filter((F.col("n") >= LEAST) & ~F.col("word").rlike("[0-9]")).select(F.col("word").alias("correct"), F.col("n").alias("m"), "h")
    # the shifts are a fixed table; a word takes those whose look-alikes it holds, found by the first of them
    letters = F.array_distinct(F.split("word", "(?!^)(?=.)"))
    odd = hashed.withColumn("letters", letters).withColumn("key", F.explode("letters")).join(
        F.broadcast(table.withColumn("key", F.substring("needs", 1, 1)).withColumn("rest", F.split("needs", "(?!^)(?=.)"))), "key"
    )
    odd = odd.filter(F.size(F.array_except("rest", "letters")) == 0).select("word", "n", (F.col("h") - F.col("shift")).alias("h"), "errors")
    mixed = F.col("word").rlike("[0-9]")
    enough = F.when(mixed, F.col("m") >= RATIO_MIXED * F.col("n")).otherwise((F.length("word") >= 3) & (F.col("m") >= RATIO * F.col("n")))
    near = odd.join(frequent, "h").filter(folded(F.col("word")) == folded(F.col("correct"))).select("word", "n", "correct", "m", "errors")
    # words with more errors than are listed differ from their variants by look-alikes alone too
    fold = lambda c: folded(F.col(c)).alias("fold")
    more = (
        hashed.filter(F.col("word").rlike("(?:[c01l58h692zgbsieowmnrv].*){4}")).select("word", "n", fold("word")).join(frequent.select("correct", "m", fold("correct")), "fold")
        .withColumn("errors", F.levenshtein("word", "correct")).filter(F.col("errors") > MOST_ERRORS).select("word", "n", "correct", "m", "errors")
    )
    return (
        near.unionByName(more).filter((F.col("word") != F.col("correct")) & enough)
        .groupBy("word").agg(F.max(F.struct("m", -F.col("errors"), "correct"))["correct"].alias("correct"))
    )


def number_corrections(texts: DataFrame) -> DataFrame:
    """seen, correct: shapes of numbers (digits as 0) with letters in them, whose variant without letters is a frequent shape.

    The letters shift the hash of a shape by fixed differences, so that rare shapes join frequent ones on equal shifted hashes.
    """
    digits = F.translate(F.col("number"), "123456789", "000000000")
    plain = texts.filter(F.col("text").rlike("[0-9]")).select(F.explode(F.regexp_extract_all("text", F.lit(f"({NUMBER})"), 1)).alias("number"))
    usual = texts.sparkSession.createDataFrame([(x, 1 << 40) for x in SHAPES], "correct string, m long")
    counted = plain.groupBy(digits.alias("correct")).agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= LEAST)
    frequent = counted.unionByName(usual).groupBy("correct").agg(F.max("m").alias("m")).withColumn("h", anagram_hash(F.col("correct"), POWER))
    read = texts.filter(F.col("text").rlike("[OolI]")).select(F.explode(F.regexp_extract_all("text", F.lit(f"({DIGITS_READ}|{LETTERS_READ})"), 1)).alias("number"))
    rare = read.groupBy(digits.alias("seen")).agg(F.count(F.lit(1)).alias("n"))
    shift = sum((F.regexp_count("seen", F.lit(c)) * (_value(c, POWER) - _value("0", POWER)) for c in "OolI"), F.lit(0))
    rare = rare.withColumn("h", anagram_hash(F.col("seen"), POWER) - shift)
    return rare.join(frequent, "h").filter((F.translate("seen", "OolI", "0000") == F.col("correct")) & (F.col("m") >= RATIO_MIXED * F.col("n"))).select("seen").distinct()


def contexts_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every Chinese character of texts with the two characters before and after it, a row each; the text it is of; its place there.

    ^ and $ stand for what lies before and after a text, 0 for a run of digits.
    """
    codes = np.frombuffer("".join(f"^^{t}$$" for t in texts).encode("utf-32-le"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) + 4 for t in texts])]).astype(np.int64)
    digit = (codes >= 48) & (codes < 58)
    keep = np.flatnonzero(~(digit & np.concatenate([[False], digit[:-1]])))
    few = np.where(digit[keep], 48, codes[keep])
    han = np.zeros(len(few), bool)
    for a, b in HAN_RANGES:
        han |= (few >= a) & (few <= b)
    at = np.flatnonzero(han)
    rows = np.stack([few[at + k] for k in range(-2, 3)], axis=1) if len(at) else np.empty((0, 5), np.uint32)
    text = np.searchsorted(begin, keep[at], "right") - 1
    return rows, text, keep[at] - begin[text] - 2


def context_hash(rows: np.ndarray) -> np.ndarray:
    h = np.zeros(len(rows), np.uint64)
    for k in range(5):
        h = (h + rows[:, k] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _strings(rows: np.ndarray) -> list[str]:
    return np.ascontiguousarray(rows.astype("<u4")).view("<U5").ravel().tolist()


def _in_parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts that together aren't much longer than AT_ONCE."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size > AT_ONCE:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def han_contexts(texts: DataFrame) -> DataFrame:
    """context, n: every Chinese character with the two characters before and after it, and how often it occurs so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(0).to_pylist()
            for a, b in _in_parts(column):
                rows, _, _ = contexts_of([t or "" for t in column[a:b]])
                _, first, n = np.unique(context_hash(rows), return_index=True, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(_strings(rows[first]), pa.string()), pa.array(n.astype(np.int64))], ["context", "n"])

    return texts.select("text").mapInArrow(run, "context string, n long").groupBy("context").agg(F.sum("n").alias("n"))


def han_places(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """block_id, unit, place, context of the contexts of wanted.

    A filter of fixed size, sent to all tasks, leaves out most others; what it lets through wrongly falls out of the join.
    """
    mask = (1 << FILTER_BITS) - 1

    @F.pandas_udf("long")
    def spot(contexts: pd.Series) -> pd.Series:
        rows = np.array([[ord(c) for c in x] for x in contexts], np.uint32).reshape(-1, 5)
        return pd.Series((context_hash(rows) & np.uint64(mask)).astype(np.int64))

    at = wanted.select(spot("context").alias("spot"))
    words = at.groupBy(F.expr("shiftright(spot, 5)").alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(spot & 31 as int))")).alias("bits")).toPandas()
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2).to_pylist()
            for a, b in _in_parts(column):
                rows, text, place = contexts_of([t or "" for t in column[a:b]])
                h = context_hash(rows) & np.uint64(mask)
                hit = (shared.value[(h >> np.uint64(5)).astype(np.int64)] >> (h & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
                which = pa.array(text[hit] + a)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(which), batch.column(1).take(which), pa.array(place[hit].astype(np.int64)), pa.array(_strings(rows[hit]), pa.string())], ["block_id", "unit", "place", "context"]
                )

    kind = texts.schema["block_id"].dataType.simpleString()
    return texts.select("block_id", "unit", "text").mapInArrow(run, f"block_id {kind}, unit int, place long, context string").join(wanted, "context")


def han_corrections(counts: DataFrame, name: str = "han") -> DataFrame:
    """context, printed: contexts whose character is a reading of another, which is far more frequent there.

    counts has context and n. Every rare window is joined to the frequent ones that differ from it in
    the character at one place alone. Such a pair of characters is a confusion if it is listed, or if
    the corpus supports it: in several contexts, and for half of all that is seen of the character,
    two or more of the three windows around it are those of the other.
    """
    window = lambda k: F.struct(F.lit(k).alias("at"), F.col("context").substr(3 - k, 3).alias("window"))
    windows = counts.select("context", "n", F.explode(F.array(*map(window, range(3)))).alias("w")).select("context", "n", "w.*")
    known = windows.groupBy("window", "at").agg(F.sum("n").alias("n"))
    known = known.withColumn("char", F.expr("substring(window, at + 1, 1)")).withColumn("around", F.expr("overlay(window placing '_' from at + 1)"))
    frequent = known.filter(F.col("n") >= LEAST).select("around", "at", F.col("char").alias("printed"), F.col("window").alias("correct"), F.col("n").alias("m"))
    rarer = written(
        known.withColumnRenamed("char", "seen").join(frequent, ["around", "at"]).filter(F.col("m") >= RATIO * F.col("n"))
        .select("window", "at", "seen", "printed", "correct", "m"),
        f"{name}-rarer",
    )
    total = counts.groupBy(F.col("context").substr(3, 1).alias("seen")).agg(F.sum("n").alias("total"))
    derived = (
        windows.join(rarer, ["window", "at"]).groupBy("context", "seen", "printed").agg(F.count(F.lit(1)).alias("agree"), F.first("n").alias("n"))
        .filter(F.col("agree") >= 2).groupBy("seen", "printed").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("contexts"))
        .join(total, "seen").filter((F.col("contexts") >= 2) & (F.col("n") >= LEAST) & (F.col("n") >= SUPPORT * F.col("total"))).select("seen", "printed")
    )
    listed = counts.sparkSession.createDataFrame([(s, t, True) for t, s in HAN_CONFUSIONS], "seen string, printed string, listed boolean")
    best = (
        rarer.join(listed.unionByName(derived.withColumn("listed", F.lit(False))), ["seen", "printed"])
        .groupBy("window", "at").agg(F.max(F.struct("listed", "m", "correct")).alias("b")).select("window", "at", "b.*")
    )
    printed = F.max(F.struct("listed", "m", F.expr("substring(correct, at + 1, 1)").alias("printed")))["printed"].alias("printed")
    return windows.join(best, ["window", "at"]).groupBy("context").agg(printed)


@dataclass
class Scanned:
    """found: block_id and noise, one row each. repaired: block_id, unit and text, corrected."""

    found: DataFrame
    repaired: DataFrame


def clean_scans(df: DataFrame, name: str = "scans") -> Scanned:
    """Finds and repairs hyphen_break, misread, running_header and page_number in text and image captions.

    df has block_id, file_path, page_idx, type, text, image_caption and ingested_at; other columns
    are not read. Blocks sent twice count once; a null key is no block; null, empty and blank texts
    have no noise. A number is a page number if it fits the file's printed numbers, where these are
    known. Empty tables give no rows. Very long texts are read line by line and word by word.
    """
    blocks = written(records(df), f"{name}-blocks")
    lines = written(furniture(blocks, lines_of(blocks), name), f"{name}-lines")
    units = written(running_units(lines.filter(~F.col("is_header") & ~F.col("is_page"))), f"{name}-units")
    breaks = written(broken_words(units, name), f"{name}-broken")
    texts = written(unit_texts(units, breaks), f"{name}-texts")
    words = F.filter(F.regexp_extract_all(F.lower("text"), F.lit(f"({WORD})"), 1), lambda w: w.rlike("[a-z]"))
    latin_texts = texts.filter(F.col("text").rlike("[A-Za-z]"))
    counted = latin_texts.select(F.explode(words).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    latin = written(latin_corrections(written(counted, f"{name}-words")), f"{name}-latin")
    misread_words = latin_texts.select("block_id", "unit", F.explode(F.array_distinct(words)).alias("word")).join(latin, "word")
    counts = written(han_contexts(texts), f"{name}-contexts")
    han = written(han_corrections(counts, name), f"{name}-han")
    misread_han = written(han_places(texts, han), f"{name}-places")
    shapes = written(number_corrections(texts), f"{name}-numbers")
    # a text may hold several numbers: each is looked up by its shape
    numbers = texts.filter(F.col("text").rlike("[OolI]")).select("block_id", "unit", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(f"({DIGITS_READ}|{LETTERS_READ})"), 1))).alias("number"))
    misread_numbers = numbers.withColumn("seen", F.translate("number", "123456789", "000000000")).join(shapes, "seen").select("block_id", "unit", "number")
    noise = lambda d, what: d.select("block_id", F.lit(what).alias("noise"))
    found = (
        noise(lines.filter("is_header"), "running_header").unionByName(noise(lines.filter("is_page"), "page_number"))
        .unionByName(noise(breaks.filter("broken"), "hyphen_break")).unionByName(noise(misread_words, "misread"))
        .unionByName(noise(misread_han, "misread")).unionByName(noise(misread_numbers, "misread")).distinct()
    )
    by_unit = misread_words.groupBy("block_id", "unit").agg(F.map_from_entries(F.collect_set(F.struct("word", "correct"))).alias("words"))
    by_han = misread_han.groupBy("block_id", "unit").agg(F.collect_list(F.struct("place", "printed")).alias("places"))
    by_number = misread_numbers.groupBy("block_id", "unit").agg(F.collect_set("number").alias("numbers"))
    keep_case = lambda old, new: F.when(F.upper(F.substring(old, 1, 1)) == F.substring(old, 1, 1), F.initcap(new)).otherwise(new)
    fixed = F.transform(F.regexp_extract_all("text", F.lit(rf"({WORD}|[^A-Za-z0-9]+)"), 1), lambda t: F.coalesce(keep_case(t, F.try_element_at(F.col("words"), F.lower(t))), t))
    # numbers are split off where they stand as such, so that like letters elsewhere stay
    pattern = f"{DIGITS_READ}|{LETTERS_READ}"
    mended = F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), 1), lambda t: F.when(F.array_contains("numbers", t), F.translate(t, "OolI", "0011")).otherwise(t))
    renumbered = F.array_join(F.zip_with(F.split("text", pattern), F.concat(mended, F.array(F.lit(""))), lambda x, y: F.concat(F.coalesce(x, F.lit("")), F.coalesce(y, F.lit("")))), "")
    put = lambda text, x: F.overlay(text, x["printed"], (x["place"] + 1).cast("int"), F.lit(1))
    repaired = (
        texts.join(by_unit, ["block_id", "unit"], "left").join(by_han, ["block_id", "unit"], "left").join(by_number, ["block_id", "unit"], "left")
        .withColumn("text", F.when(F.col("places").isNull(), F.col("text")).otherwise(F.aggregate("places", F.col("text"), put)))
        .withColumn("text", F.when(F.col("numbers").isNull(), F.col("text")).otherwise(renumbered))
        .withColumn("text", F.when(F.col("words").isNull(), F.col("text")).otherwise(F.array_join(fixed, "")))
        .select("block_id", "unit", "text")
    )
    return Scanned(found, repaired)
