"""Freely typed values mapped to the entries of a reference list.

The distinct values are cleaned and cut into tokens: the words, and the whole value without
spaces. Each distinct token is repaired by joining it to the reference vocabulary by edit
distance, in which neighbours that changed places count as one edit. The join is exact: a token
of the vocabulary that may differ by k insertions, deletions and substitutions (two for each edit,
as all may be swaps) is cut into k + 1 segments, of which one must survive unchanged within k places
of its own, so that equality of segments finds every pair before the distance is computed. The
repaired tokens are combined by soft TF-IDF to rank whole names; the best name of a value gives its
entry.
"""

from __future__ import annotations

from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.utils import is_remote

#: Words before a value that say only what kind of value follows.
LABELS = r"^\s*(?:type|label|kind|category|class|relation|name|类型|类别|关系|标签|名称)\s*[:=]\s*"
NUMBERING = r"^\s*(?:[#*•·]\s*)*(?:[(\[]?\s*\d{1,3}\s*[.)、\]:]\s*)?"
HIDDEN = r"[­᠎​-‏⁠﻿̀-ͯ]"
#: Names that differ by more than this share of their length are not the same.
SHARE = 0.34


#: Blocks of Chinese characters whose traditional forms are looked up.
HAN = ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xF900, 0xFB00))


@lru_cache(maxsize=1)
def _simplified(spark: SparkSession) -> tuple[str, str]:
    """Traditional characters and their simplified forms, by the transliteration that comes with the engine. An error where it can't be reached: without it values would seem to mean no entry."""
    if is_remote():
        raise RuntimeError("traditional characters are simplified by the driver's engine, which a session that only talks to a server can't reach")
    try:
        rule = spark._jvm.com.ibm.icu.text.Transliterator.getInstance("Traditional-Simplified")
    except Exception as e:
        raise RuntimeError("the transliteration of traditional characters (ICU, among Spark's jars) can't be reached") from e
    chars = [chr(c) for a, b in HAN for c in range(a, b)]
    pairs = [(x, y) for x, y in zip(chars, rule.transliterate("\n".join(chars)).split("\n"), strict=True) if x != y and len(y) == 1]
    return "".join(x for x, _ in pairs), "".join(y for _, y in pairs)


def _wide() -> tuple[str, str]:
    """Full-width forms and their ASCII forms."""
    codes = range(0xFF01, 0xFF5F)
    return "".join(map(chr, codes)) + "　", "".join(chr(c - 0xFEE0) for c in codes) + " "


def cleaned(value: Column, simple: tuple[str, str]) -> Column:
    """Lower case, half width, simplified by the given characters, without hidden characters, label and number; camel case and marks become spaces."""
    v = F.regexp_replace(value, HIDDEN, "")
    v = F.translate(v, *_wide())
    v = F.regexp_replace(v, r"([a-z])([A-Z])", "$1 $2")
    v = F.lower(F.translate(v, *simple))
    return F.regexp_replace(F.regexp_replace(v, NUMBERING, ""), LABELS, "")


def plain(part: Column) -> Column:
    """Letters and digits with single spaces; no spaces beside Chinese characters."""
    p = F.trim(F.regexp_replace(part, r"[^\p{L}\p{N}]+", " "))
    p = F.regexp_replace(p, r"(?<=\p{IsHan}) +(?=\p{IsHan})", "")
    return F.when(F.length(p) > 2, F.regexp_replace(p, r"(?<=\p{IsHan})类$", "")).otherwise(p)


def parts(value: Column, simple: tuple[str, str]) -> Column:
    """The value's alternatives: what stands before, inside and beside brackets, strokes and slashes, and their concatenation."""
    found = F.transform(F.split(cleaned(value, simple), r"[()|/\[\]【】]"), plain)
    return F.array_distinct(F.filter(found, lambda p: p != ""))


def allowed(length: Column) -> Column:
    """Edits that a name of this length may suffer."""
    return F.when(length <= 5, 1).when(length <= 7, 2).otherwise(F.floor(length * SHARE)).cast("int")


def swap_distance(a: str, b: str) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours that turn a into b."""
    before, last = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, now[j - 1] + 1, last[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            now.append(d)
        before, last = last, now
    return last[-1]


@F.pandas_udf(T.IntegerType())
def swap_distances(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([swap_distance(x, y) for x, y in zip(a, b)], dtype="int32")


def tokens(part: Column) -> Column:
    """The words of a part and, marked by =, the part without spaces."""
    squeezed = F.concat(F.lit("="), F.regexp_replace(part, " ", ""))
    return F.array_distinct(F.concat(F.array(squeezed), F.split(part, " ")))


def repaired(found: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """token, word, sim: each distinct token of found with every vocabulary word within the allowed edits."""
    bare = lambda c: F.regexp_replace(c, "^=", "")
    v = (
        vocabulary.select("word").distinct().withColumn("bare", bare(F.col("word"))).withColumn("long", F.length("bare"))
        .withColumn("most", F.least(allowed(F.col("long")), F.col("long") - 1))
        .withColumn("k", F.least(F.col("most") * 2, F.greatest(F.col("long") - 1, F.lit(0))))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.col("k"))))
        .withColumn("from", F.floor(F.col("i") * F.col("long") / (F.col("k") + 1)).cast("int"))
        .withColumn("to", F.floor((F.col("i") + 1) * F.col("long") / (F.col("k") + 1)).cast("int"))
        .withColumn("segment", F.expr("substring(bare, from + 1, to - from)"))
    )
    sizes = v.agg(F.min(F.col("to") - F.col("from")).alias("a"), F.max(F.col("to") - F.col("from")).alias("b"), F.max("long").alias("c"))
    low, high, longest = sizes.first()
    if low is None:
        return found.select("token", F.lit("").alias("word"), F.lit(0.0).alias("sim")).limit(0)
    # a token beyond twice the longest word can't be within its edits of any
    t = (
        found.select("token").distinct().withColumn("bare", bare(F.col("token"))).withColumn("long", F.length("bare"))
        .filter((F.col("long") > 0) & (F.col("long") <= 2 * longest))
        .withColumn("size", F.explode(F.sequence(F.lit(low), F.lit(high))))
        .filter(F.col("size") <= F.col("long"))
        .withColumn("at", F.explode(F.sequence(F.lit(0), F.col("long") - F.col("size"))))
        .withColumn("segment", F.expr("substring(bare, at + 1, size)"))
    )
    near = (
        t.alias("t").join(
            v.alias("v"),
            (F.col("t.segment") == F.col("v.segment")) & (F.abs(F.col("t.at") - F.col("v.from")) <= F.col("v.k"))
            & (F.abs(F.col("t.long") - F.col("v.long")) <= F.col("v.k")) & (F.col("t.token").startswith("=") == F.col("v.word").startswith("=")),
        )
        .select("t.token", "v.word", F.col("t.bare").alias("a"), F.col("v.bare").alias("b"), "v.k", "v.most", F.col("v.long").alias("long"))
        .distinct()
        .filter(F.levenshtein("a", "b") <= F.col("most") * 2)
    )
    return near.withColumn("d", swap_distances("a", "b")).filter(F.col("d") <= F.col("most")).select("token", "word", (1 - F.col("d") / F.col("long")).alias("sim"))


def map_to_canonical(values: DataFrame, entries: DataFrame, least: float = 0.62) -> DataFrame:
    """kind, value, canonical_id, score: each distinct value of values with the entry of its kind meant by it, or 0.

    values has kind and value; entries has canonical_id, kind and names (all spellings). Null and
    blank values give no row. A value of marks alone, or one that resembles no name, gives 0. Ties
    go to the greater similarity of the whole, then to the smaller id. An empty list maps all to 0.
    Where the rule for traditional characters can't be reached this is an error.
    """
    simple = _simplified(values.sparkSession)
    names = (
        entries.select("canonical_id", "kind", F.explode("names").alias("name"))
        .filter(F.col("name").isNotNull())
        .withColumn("name", F.explode(parts(F.col("name"), simple)))
        .distinct()
    )
    name_words = names.withColumn("word", F.explode(tokens(F.col("name"))))
    n = names.count()
    idf = name_words.groupBy("word").agg(F.log(1 + F.lit(n) / F.count(F.lit(1))).alias("idf"))
    # squeezed forms answer for the whole, words for their share of the name
    weighed = name_words.join(idf, "word").withColumn("whole", F.col("word").startswith("="))
    norm = weighed.filter(~F.col("whole")).groupBy("kind", "canonical_id", "name").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("name_norm"))
    weighed = weighed.join(norm, ["kind", "canonical_id", "name"])

    distinct = values.filter(F.length(F.regexp_replace("value", r"(?U)^\s+|\s+$", "")) > 0).select("kind", "value").distinct()
    pieces = distinct.withColumn("part", F.explode(parts(F.col("value"), simple)))
    tokened = pieces.select("kind", "value", "part", F.explode(tokens(F.col("part"))).alias("token"))
    fixes = repaired(tokened, name_words)
    top = F.log(F.lit(1.0 + n))
    best_idf = fixes.join(idf, "word").groupBy("token").agg(F.max(F.col("sim") * F.col("idf")).alias("weight"))
    part_norm = (
        tokened.filter(~F.col("token").startswith("=")).join(best_idf, "token", "left")
        .groupBy("kind", "value", "part").agg(F.sqrt(F.sum(F.pow(F.coalesce("weight", top), 2))).alias("part_norm"))
    )
    linked = tokened.join(fixes, "token").join(weighed, ["kind", "word"])
    per_name = (
        linked.groupBy("kind", "value", "part", "canonical_id", "name")
        .agg(
            F.max(F.when(F.col("whole"), F.col("sim"))).alias("whole_sim"),
            F.sum(F.when(~F.col("whole"), F.col("sim") * F.col("sim") * F.col("idf") * F.col("idf"))).alias("dot"),
            F.first("name_norm").alias("name_norm"),
        )
        .join(part_norm, ["kind", "value", "part"], "left")
    )
    # a lone shared word isn't the name: words count only where they make most of both sides
    soft = F.coalesce(F.col("dot") / (F.col("name_norm") * F.col("part_norm")), F.lit(0.0))
    scored = per_name.withColumn("whole_sim", F.coalesce("whole_sim", F.lit(0.0))).withColumn("score", F.greatest("whole_sim", soft))
    best = (
        scored.filter(F.col("score") >= least)
        .groupBy("kind", "value")
        .agg(F.max(F.struct("score", "whole_sim", (-F.col("canonical_id")).alias("minus_id"))).alias("best"))
    )
    return distinct.join(best, ["kind", "value"], "left").select(
        "kind", "value", F.coalesce(-F.col("best.minus_id"), F.lit(0)).cast("int").alias("canonical_id"), F.coalesce("best.score", F.lit(0.0)).alias("score")
    )
