"""Broken prompt-response pairs: empty, truncated, refusing, copying and foreign-language answers.

Truncation is looked for in three ways. Distinct answers are range-partitioned and sorted by
text, and neighbours' common prefixes show which answer is the shortened version of another.
Spikes in the lengths of unfinished answers show length limits. What is left is judged by how
texts of this corpus end: counts of the character contexts that precede the end of a sentence
in all distinct answers, blended from short to long contexts. Copy, refusal and language rules are expressions over the single pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from spindle.session import written

START, CONTEXTS = 0.05, (1, 2, 3, 4, 5, 6, 8, 10, 13, 17, 22)
#: Characters by which a clause begins and ends where what stands between varies: Chinese, others.
FRAME_ZH, FRAME = (4, 2), (10, 4)
#: An unfinished length that holds so many times the mean of its neighbours, and so many deviations more than chance gives, is a limit.
SPIKE, DEVIATIONS = 8.0, 8.0
#: What is said besides declining (or besides stating that evidence is lacking), as a multiple of that, up to which an answer declines.
BESIDES = 1.5
#: Bits of the filter by which contexts that no open answer ends with are left out early, as a power of two; characters counted at once.
FILTER_BITS, AT_ONCE = 24, 200_000

# Labels, placeholders, refusals and function words.
LABELS = r"(?i)^[\s\"'“‘*#>]*(?:您问的是|您的问题是|参考答案|标准答案|答案|回答|问题|提问|答|问|you asked|your question(?: was| is)?|the question(?: was| is)?|question|answer|response|reply|q|a)\s*[:：]\s*"
PLACEHOLDERS = (
    "无 暂无 空 没有 略 无内容 暂缺 待补充 待补 待定 待完善 待填写 未填写 未填 未提供 无答案 暂无答案 暂无内容 "
    "na none null nil nan tbd tba todo empty blank undefined missing noanswer notavailable notapplicable nocontent"
).split()
REFUSALS_ZH = (
    r"(?:无法|不能|不便|没办法|没法|难以|不予|恕不|恕难|拒绝|不会|不宜|无权|不可以)(?:就此|对此|为您|为你|向您|给您|继续|再)?(?:对[^。，；]{0,10})?"
    r"(?:回答|作答|解答|答复|提供|给出|完成|作出|做出|处理|协助|满足|帮助|讨论|回应|评论|给予|透露|建议)"
    r"|回答不了|答不了|帮不了|无可奉告|恕不|(?:不在|超出)[^。，；]{0,8}(?:范围|能力|权限)|作为(?:一个|一名)?(?:AI|ai|语言模型|人工智能)"
)
REFUSALS_EN = (
    r"(?i)\b(?:can ?not|can['’]t|won['’]t|will not|unable to|not able to|must decline|have to decline|decline to|refuse to|not (?:allowed|permitted|authori[sz]ed|in a position) to|may not)\b"
    r"\W++(?:[\w'’]++\W++){0,4}?(?:help|answer|assist|provide|complete|give|discuss|respond|reply|comment|advise|judge|assess|share|offer|make|fulfil|fulfill|do|continue|talk|address|say|process)\b"
    r"|\b(?:must|have to|i) (?:respectfully )?decline\b|\bbeyond (?:my|our) (?:scope|abilit|capabilit)|\boutside (?:of )?(?:my|our|what i)\b|\bas an? (?:ai|artificial|language|large language)\b"
    r"|\bno information (?:on|about) (?:this|that)\b.{0,30}\b(?:cannot|can't)\b|\bnot something i can\b"
)
INSUFFICIENT = r"(?i)证据不足|不足以(?:回答|判断|得出)|not enough evidence|insufficient evidence|evidence (?:given )?(?:does not|is not|do not)|no conclusion can"
NAMING = r"(?i)英文|英语|学名|拉丁|法文|法语|德文|德语|日文|日语|俄文|俄语|西班牙|葡萄牙|外文|中文|汉语|chinese|english|latin|french|german|japanese|russian|spanish|portuguese|scientific name|what is [^?]{0,60}called in"
WORDS = {
    "en": "the of and is in to on with for from by at when which that are only before not more or it than as",
    "fr": "le la les des du et est dans une un pour sur avec que qui ne pas au aux après il faut doivent être par sont puis en",
    "es": "el la los las del y es en una un para con que por se no al según cuando más sea haya sólo como su",
    "de": "der die das und ist in den dem ein eine nicht mit von zu auf für bei sich im werden wird sie aus nach",
    "pt": "o a os as do da dos das e em uma um para com que por não no na ao após se mais são de",
    "it": "il lo la gli le di e in una un per con che non al dei delle si sono è dopo",
}
ENDS = "。！？!?；;．｡"
CLOSERS = r"[\"'”’」』》】\]\)）\s​*_`]"
OMISSION = r"(?i)\s*(?:[\[(（【<]\s*(?:续|未完(?:待续)?|待续|cont(?:inued|['’]d|\.)?|truncated|more|略|下略|以下省略|省略|\.{2,}|…+)?\s*[\])）】>]?|…+|\.{2,}|。{2,}|\bcont(?:inued|['’]d)?\.?|-{2,}|—+)\s*$"
HIDDEN = r"[\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}\x{180e}]"


def core_letters(c: Column) -> Column:
    """Letters and digits alone, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")


def unlabelled(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, HIDDEN, ""), LABELS, "")


def count_of(c: Column, pattern: str) -> Column:
    return F.regexp_count(c, F.lit(pattern))


SCRIPTS = {
    "han": r"\p{IsHan}", "kana": r"[\p{IsHiragana}\p{IsKatakana}]", "ko": r"\p{IsHangul}", "ru": r"\p{IsCyrillic}",
    "ar": r"\p{IsArabic}", "th": r"\p{IsThai}", "latin": r"\p{IsLatin}",
}


def with_language(df: DataFrame, text: str, to: str) -> DataFrame:
    """Adds the language of a text: zh, ja, ko, ru, ar or th by script; en, fr, es, de, pt or it by function words; else null.

    What is counted becomes a column of its own first, so that each pattern runs once a text.
    """
    counts = F.struct(*[count_of(F.col(text), p).alias(k) for k, p in SCRIPTS.items()])
    lower = F.concat(F.lit(" "), F.regexp_replace(F.lower(text), r"[^\p{L}]+", "  "), F.lit(" "))
    df = df.withColumn(f"{to}_n", counts).withColumn(f"{to}_words", F.when(F.col(f"{to}_n.latin") > 0, lower))
    hits = F.struct(*[count_of(F.col(f"{to}_words"), " (?:" + "|".join(w.split()) + ") ").alias(k) for k, w in WORDS.items()])
    df = df.withColumn(f"{to}_hits", hits)
    n = {k: F.col(f"{to}_n.{k}") for k in SCRIPTS}
    # a Chinese character says about as much as two or three letters
    df = df.withColumn(f"{to}_wide", (n["han"] + n["kana"]) * 2.5)
    wide = F.col(f"{to}_wide")
    most = F.greatest(wide, n["ko"] * 2.5, n["ru"], n["ar"], n["th"], n["latin"])
    best = F.greatest(*[F.coalesce(F.col(f"{to}_hits.{k}"), F.lit(0)) for k in WORDS])
    df = df.withColumn(f"{to}_most", most).withColumn(f"{to}_best", best)
    most, best = F.col(f"{to}_most"), F.col(f"{to}_best")
    latin = F.when(best == 0, F.lit(None))
    for k in WORDS:  # English first: it wins ties
        latin = latin.when(F.col(f"{to}_hits.{k}") == best, k)
    found = (
        F.when(most == 0, F.lit(None)).when((most == wide) & (n["kana"] * 25 > wide), "ja").when(most == wide, "zh")
        .when(most == n["ko"] * 2.5, "ko").when(most == n["ru"], "ru").when(most == n["ar"], "ar").when(most == n["th"], "th").otherwise(latin)
    )
    return df.withColumn(to, found).drop(*[f"{to}_{x}" for x in ("n", "words", "hits", "wide", "most", "best")])


def is_empty(answer: Column, rest: Column) -> Column:
    """Null, or no letters but those of a label or a placeholder; rest has the letters of the answer without its label."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(answer, HIDDEN, "")), r"[^\p{L}\p{N}]+", "")
    label = r"^(?:参考答案|标准答案|答案|回答|答|answer|response|reply|a|question|q)$"
    return answer.isNull() | (rest == "") | rest.isin(PLACEHOLDERS) | bare.rlike(label)


def is_copy(q: Column, a: Column) -> Column:
    """The letters of the answer are the question's but for a sixth, a large part of them, or the question repeated."""
    near = (F.length(a) <= F.length(q) * 1.17) & (F.length(a) >= F.length(q) * 0.8)
    close = near & (F.levenshtein(a, q) <= F.ceil(F.length(q) * 0.16))
    part = (F.length(a) >= F.length(q) * 0.6) & q.contains(a) & (F.length(a) >= 6)
    again = a.startswith(q) & (F.replace(a, q, F.lit("")) == "")
    return (F.length(q) > 0) & (F.length(a) > 0) & (close | part | again)


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[。！？!?])|(?<=\.)\s+|\n+"), lambda s: F.length(F.trim(s)) > 0)


def mostly(said: Column, test) -> Column:
    """Whether sentences that pass the test make the most of what is said; Chinese characters count twice."""
    weight = lambda s: F.length(s) + F.regexp_count(s, F.lit(r"\p{IsHan}"))
    both = F.aggregate(
        said, F.struct(F.lit(0).alias("yes"), F.lit(0).alias("no")),
        lambda n, s: F.when(test(s), F.struct((n["yes"] + weight(s)).alias("yes"), n["no"].alias("no"))).otherwise(F.struct(n["yes"].alias("yes"), (n["no"] + weight(s)).alias("no"))),
        lambda n: (n["yes"] > 0) & (n["no"] <= n["yes"] * BESIDES),
    )
    return both


def is_refusal(task: Column, answer: Column, expected: str) -> Column:
    """Sentences that decline make the most of the answer; the statement that evidence is lacking is none where it is expected.

    answer is without its label. The shares are of what is said, so that long answers are judged like short ones.
    """
    declines = lambda s: s.rlike(REFUSALS_ZH) | s.rlike(REFUSALS_EN)
    said = sentences(answer)
    stated = answer.rlike(INSUFFICIENT)
    fits = task.isNull() | (F.regexp_replace(task, r"(?U)^\s+|\s+$", "") == expected)
    # sentences are looked at one by one only where the whole has what is looked for
    declined = F.when(declines(answer), mostly(said, declines)).otherwise(False)
    lacking = F.when(stated & ~fits, mostly(said, lambda s: s.rlike(INSUFFICIENT))).otherwise(False)
    return (declined & ~(stated & fits)) | lacking


def is_foreign(question: Column, answer: Column, ql: Column, al: Column) -> Column:
    """The language of the answer isn't that of the question. Names don't count, nor does a term the question asks for."""
    short = (count_of(answer, r"\p{L}[\p{L}\p{M}'’-]*") <= 6) & (count_of(answer, r"\p{IsHan}") <= 12)
    # Latin letters without function words are names, unless they make a whole text
    latin_text = al.isNull() & ~ql.isin(*WORDS) & (count_of(answer, r"\p{IsLatin}+") >= 8) & (count_of(answer, r"\p{IsHan}") == 0)
    return ql.isNotNull() & ((al.isNotNull() & (al != ql)) | latin_text) & ~(question.rlike(NAMING) & short)


def squeezed(texts: pd.Series) -> pd.Series:
    """Runs of digits become 0, white space one blank; what the contexts are counted on."""
    return texts.str.replace(r"\d+(?:[.,]\d+)*", "0", regex=True).str.replace(r"\s+", " ", regex=True)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


def _context_keys(codes: np.ndarray, size: int) -> np.ndarray:
    """A hash of the size characters that end at each place from size - 1 on."""
    h = np.zeros(max(0, len(codes) - size + 1), np.uint64)
    for i in range(size):
        h = (h + codes[i : len(codes) - size + 1 + i] + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def _frames(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of how the clause begins and of the last characters, at each place where the two don't overlap."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    place = np.arange(n)
    marks = np.isin(codes, _codes(ENDS + "，、：,.:\n"))
    begin = np.maximum.accumulate(np.where(marks, place + 1, 0))
    begin = np.minimum(begin + (codes[np.minimum(begin, n - 1)] == 32), n - 1)
    wide = codes[begin] >= 0x2E80
    out = []
    for which, (head, tail) in ((wide, FRAME_ZH), (~wide, FRAME)):
        at = place[which & ~marks & (place - begin + 1 >= head + tail)]
        if len(at):
            heads, tails = _context_keys(codes, head), _context_keys(codes, tail)
            out.append((heads[begin[at]] * np.uint64(0xC2B2AE3D27D4EB4F) ^ tails[at - tail + 1], at))
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    keys, at = (np.concatenate(x) for x in zip(*out))
    order = np.argsort(at, kind="stable")
    return keys[order], at[order]


def context_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Number, keys, totals and sentence ends of each size of context in turn, then of the frames; texts are squeezed."""
    codes = _codes("\n".join(texts) + "\n")
    follows = codes[1:]
    ends = np.isin(follows, _codes(ENDS))
    blank = np.isin(np.append(follows[1:], 10), [32, 10])
    ends |= (follows == ord(".")) & blank
    usable = (follows != 10) & ~np.isin(codes[:-1], [10])  # an unfinished end says nothing

    def counted(keys: np.ndarray, use: np.ndarray, final: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, inverse = np.unique(keys[use], return_inverse=True)
        return known, np.bincount(inverse, minlength=len(known)), np.bincount(inverse, weights=final[use], minlength=len(known))

    for i, size in enumerate(CONTEXTS):
        yield i, *counted(_context_keys(codes[:-1], size), usable[size - 1 :], ends[size - 1 :])
    keys, places = _frames(codes[:-1])
    yield len(CONTEXTS), *counted(keys, usable[places], ends[places])


def context_keys(text: str) -> list[int | None]:
    """The key of each size of context at the end of a squeezed text, then that of its frame; None where there is none."""
    whole = _codes(text)
    codes = whole[-CONTEXTS[-1] :]
    out = [int(_context_keys(codes[-size:], size)[0].view(np.int64)) if size <= len(codes) else None for size in CONTEXTS]
    keys, places = _frames(whole)
    return [*out, int(keys[-1].view(np.int64)) if len(places) and places[-1] == len(whole) - 1 else None]


def finalities(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """text, finality of each distinct text of asked: what SentenceEnds gives, counted over all distinct texts of texts.

    Only contexts that an asked text ends with are counted. A filter of fixed size, sent to all tasks,
    leaves out most of the others before the shuffle; what it lets through wrongly falls out of the join.
    """

    @F.pandas_udf("array<bigint>")
    def ends_of(column: pd.Series) -> pd.Series:
        return squeezed(column).map(lambda t: context_keys(t.rstrip()))

    ends = written(asked.filter(F.col("text").isNotNull()).select("text").distinct().withColumn("keys", ends_of("text")), "ends")
    wanted = ends.select("text", F.posexplode("keys").alias("kind", "key")).filter(F.col("key").isNotNull())
    words = (
        wanted.select(F.expr(f"shiftright(key & {(1 << FILTER_BITS) - 1}L, 5) at"), F.expr("shiftleft(1L, cast(key & 31 as int)) bit"))
        .groupBy("at").agg(F.bit_or("bit").alias("bits")).toPandas()
    )
    bits = np.zeros(1 << (FILTER_BITS - 5), np.uint32)
    bits[words["at"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64).astype(np.uint32)
    shared = texts.sparkSession.sparkContext.broadcast(bits)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            column = squeezed(frame["text"])
            part = (column.str.len().cumsum() // AT_ONCE).to_numpy()
            for _, some in column.groupby(part):
                for kind, keys, total, final in context_counts(some.tolist()):
                    at = keys & np.uint64((1 << FILTER_BITS) - 1)
                    hit = (shared.value[(at >> np.uint64(5)).astype(np.int64)] >> (at & np.uint64(31)).astype(np.uint32)) & np.uint32(1) == 1
                    yield pd.DataFrame({"kind": np.full(hit.sum(), kind, np.int32), "key": keys[hit].view(np.int64), "total": total[hit].astype(np.int64), "final": final[hit].astype(np.int64)})

    counts = texts.filter(F.col("text").isNotNull()).select("text").distinct().mapInPandas(run, "kind int, key bigint, total bigint, final bigint")
    counts = counts.groupBy("kind", "key").agg(F.sum("total").alias("total"), F.sum("final").alias("final"))
    found = wanted.join(counts, ["kind", "key"]).groupBy("text").agg(F.array_sort(F.collect_list(F.struct("kind", "total", "final"))).alias("seen"))

    # from short to long for as long as each is known, then the frame
    frame, sizes = len(CONTEXTS), F.array(*map(F.lit, CONTEXTS))
    blend = lambda x, p: (x["final"] + p * 1.5) / (x["total"] + 1.5)
    known = lambda a, x: (x["kind"] == a["next"]) & (x["kind"] < frame) & ((x["total"] >= 2) | (F.get(sizes, x["kind"]) <= 4))
    step = lambda a, x: (
        F.when(known(a, x), F.struct(blend(x, a["p"]).alias("p"), (a["next"] + 1).alias("next")))
        .when((x["kind"] == frame) & (x["total"] >= 3), F.struct(blend(x, a["p"]).alias("p"), a["next"].alias("next"))).otherwise(a)
    )
    start = F.struct(F.lit(START).alias("p"), F.lit(0).alias("next"))
    p = F.when(F.col("seen").isNull(), F.lit(START)).otherwise(F.aggregate("seen", start, step)["p"])
    return ends.select("text").join(found, "text", "left").select("text", p.alias("finality"))


class SentenceEnds:
    """How often the end of a sentence follows each context of the given texts: finalities in memory, for few texts."""

    def __init__(self, texts: list[str]):
        *tables, self.frames = [x[1:] for x in context_counts(squeezed(pd.Series(texts, dtype="object")).tolist())]
        self.tables = []
        for size, (known, total, final) in zip(CONTEXTS, tables):
            seen = total >= (2 if size > 4 else 1)
            self.tables.append((known[seen], total[seen], final[seen]))

    def finality(self, text: str) -> float:
        """The chance that a sentence ends where the text does, blended from short to long contexts and to the frame of the clause."""
        whole = _codes(text)
        codes = whole[-CONTEXTS[-1] :]
        p = START
        for size, (known, total, final) in zip(CONTEXTS, self.tables):
            if size > len(codes) or not len(known):
                break
            key = _context_keys(codes[-size:], size)[0]
            i = int(np.searchsorted(known, key))
            if i >= len(known) or known[i] != key:
                break
            p = (final[i] + 1.5 * p) / (total[i] + 1.5)
        keys, places = _frames(whole)
        if len(places) and places[-1] == len(whole) - 1:
            known, total, final = self.frames
            i = int(np.searchsorted(known, keys[-1]))
            if i < len(known) and known[i] == keys[-1] and total[i] >= 3:
                p = (final[i] + 1.5 * p) / (total[i] + 1.5)
        return float(p)


def shortened_versions(texts: DataFrame) -> DataFrame:
    """text, goes_on: each distinct text that is a prefix of another, with the character by which the next longer one goes on.

    If a text is a prefix of any, it is one of its neighbour in the order of all texts. The texts
    are range-partitioned and sorted; each is compared with the next of its partition. The last of
    a partition is compared with the first of the next one that isn't empty: two rows a partition.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, before, first = TaskContext.get().partitionId(), None, None
        for frame in frames:
            out = []
            for text in frame["text"]:
                if before is None:
                    first = text
                elif text.startswith(before):
                    out.append((before, text[len(before)], number, 0))
                before = text
            if out:
                yield pd.DataFrame(out, columns=["text", "goes_on", "part", "edge"])
        if before is not None:
            yield pd.DataFrame([(first, None, number, 1), (before, None, number, 2)], columns=["text", "goes_on", "part", "edge"])

    ordered = texts.select("text").distinct().repartitionByRange("text").sortWithinPartitions("text")
    found = ordered.mapInPandas(run, "text string, goes_on string, part int, edge int")
    return written(found, "neighbours")


def joined_edges(neighbours: DataFrame) -> DataFrame:
    """The neighbours within partitions, and those across their edges."""
    w = Window.partitionBy(F.lit(1)).orderBy("part", "edge")
    edges = neighbours.filter(F.col("edge") > 0).withColumn("next", F.lead("text").over(w))
    across = edges.filter((F.col("edge") == 2) & F.col("next").startswith(F.col("text")) & (F.col("next") != F.col("text")))
    goes_on = F.expr("substring(next, length(text) + 1, 1)")
    return neighbours.filter(F.col("edge") == 0).select("text", "goes_on").unionByName(across.select("text", goes_on.alias("goes_on")))


def unfinished(text: Column) -> Column:
    """No mark that ends a sentence stands at the end, closing quotes and brackets aside."""
    bare = F.regexp_replace(text, CLOSERS + "+$", "")
    return ~bare.rlike(rf"[{ENDS}.]$")


def broken_pairs(df: DataFrame, key: str, question: str, answer: str, task: str, expected_task: str = "证据不足", name: str = "pairs") -> DataFrame:
    """key and defect of each defective pair; see judged_pairs."""
    return judged_pairs(df, key, question, answer, task, expected_task, name).select(key, "defect")


def judged_pairs(df: DataFrame, key: str, question: str, answer: str, task: str, expected_task: str = "证据不足", name: str = "pairs") -> DataFrame:
    """key, defect and evidence of each defective pair: empty_answer, copied_question, refusal, wrong_language or truncated, the first that applies.

    evidence lists what an answer is held to be truncated by: a mark of omission, what it ends in
    (promise), an open bracket, how sentences end in this corpus (ending), a longer version, a length
    limit; longer versions and limits count where the ending doesn't speak against them.

    Pairs sent twice count once, as first taken in; a null key is no pair. A null question can
    neither be copied nor have a language. Short answers (up to six words or twelve Chinese
    characters, without a mark that promises more) are never truncated. Very long answers are
    compared whole, but for the context that ends them. Empty tables give no rows. Columns not
    named are not read.
    """
    records = written(
        df.select(F.col(key).alias("key"), "ingested_at", F.col(question).alias("question"), F.col(answer).alias("answer"), F.col(task).alias("task"))
        .filter(F.col("key").isNotNull())
        .groupBy("key").agg(F.min(F.struct("ingested_at", "question", "answer", "task")).alias("r"))
        .select("key", "r.question", "r.answer", "r.task"),
        f"{name}-records",
    )
    q, a, said = F.col("question"), F.col("answer"), F.col("said")
    staged = records.withColumn("said", unlabelled(a)).withColumn("asked", unlabelled(q))
    staged = staged.withColumn("a", core_letters(said)).withColumn("q", core_letters(F.col("asked"))).drop("asked")
    staged = with_language(with_language(staged, "question", "ql"), "said", "al")
    early = (
        F.when(is_empty(a, F.col("a")), "empty_answer").when(is_copy(F.col("q"), F.col("a")), "copied_question")
        .when(is_refusal(F.col("task"), said, expected_task), "refusal").when(is_foreign(q, said, F.col("ql"), F.col("al")), "wrong_language")
    )
    staged = staged.withColumn("early", early).withColumn("full", F.regexp_replace(F.regexp_replace(a, HIDDEN, ""), r"(?U)\s+$", ""))
    # what is said before a mark of omission is what breaks off
    staged = staged.withColumn("kept", F.regexp_replace("full", OMISSION, "")).withColumn("marked", F.col("kept") != F.col("full"))
    kept = F.col("kept")
    item = kept.rlike(r"(?:^|\n)\s*(?:\d{1,3}[.)、]|[-*•])\s*$") | (F.col("marked") & kept.rlike(r"(?:^|\n)\s*\d{1,3}\s*$"))
    is_open = unfinished(kept) | item
    judged = written(
        # no filter here: it would be pushed below the columns it needs, and these be computed twice
        staged.withColumn("is_open", F.col("early").isNull() & is_open)
        .select("key", "early", F.when(F.col("is_open"), F.struct("marked", F.length(a).alias("length"))).alias("open"), F.when(F.col("is_open"), kept).otherwise(a).alias("whole")),
        f"{name}-judged",
    )
    # of an answer that may be cut off, what stands before a mark of omission is compared with other answers
    open_answers = judged.filter(F.col("open").isNotNull()).select("key", "open.*", F.col("whole").alias("kept"))
    answers = judged.filter(F.col("whole").isNotNull()).select(F.col("whole").alias("text"))
    final = finalities(answers, open_answers.select(F.col("kept").alias("text"))).withColumnRenamed("text", "kept")
    prefixes = joined_edges(shortened_versions(answers))
    prefixes = prefixes.groupBy(F.col("text").alias("kept")).agg(F.min("goes_on").alias("goes_on"))
    limits = length_limits(open_answers)
    words = count_of(F.col("kept"), r"[\p{L}\p{N}][\p{L}\p{N}'’-]*")
    brief = ~F.col("marked") & (((words <= 6) & (count_of(F.col("kept"), r"\p{IsHan}") == 0)) | ((F.length("kept") <= 12) & (count_of(F.col("kept"), r"\p{IsHan}") > 0)))
    promise = F.col("kept").rlike(r"(?:[,，、:：;；（(\[【“‘—-]|(?:^|\n)\s*(?:\d{1,3}[.)、]?|[*•]))\s*$")
    balance = sum(count_of(F.col("kept"), x) for x in (r"[（(【\[]",)) > sum(count_of(F.col("kept"), x) for x in (r"[）)】\]]",))
    # a continuation counts where it is more than the final stop
    longer = F.col("goes_on").isNotNull() & ~F.col("goes_on").rlike(rf"[{ENDS}.\s]")
    ending = F.col("finality")
    tests = {
        "promise": promise, "omission": F.col("marked"), "bracket": ~brief & balance, "ending": ~brief & (ending < 0.5),
        "longer": ~brief & longer & (ending < 0.8), "limit": ~brief & F.col("limit").isNotNull() & (ending < 0.7),
    }
    evidence = F.filter(F.array(*[F.when(F.coalesce(t, F.lit(False)), F.lit(k)) for k, t in tests.items()]), lambda x: x.isNotNull())
    cut = (
        open_answers.join(prefixes, "kept", "left").join(limits, "length", "left").join(final, "kept")
        .withColumn("evidence", evidence).filter(F.size("evidence") > 0).select("key", F.lit("truncated").alias("defect"), "evidence")
    )
    none = F.array().cast("array<string>")
    found = judged.filter(F.col("early").isNotNull()).select("key", F.col("early").alias("defect"), none.alias("evidence")).unionByName(cut)
    return found.withColumnRenamed("key", key)


def length_limits(open_answers: DataFrame) -> DataFrame:
    """length, limit: lengths at which far more answers stay unfinished than at the eight next to it, and more than chance would have it."""
    counts = open_answers.groupBy("length").agg(F.count(F.lit(1)).alias("n"))
    near = counts.select(F.explode(F.sequence(F.col("length") - 4, F.col("length") + 4)).alias("length"), F.col("n").alias("m")).groupBy("length").agg(F.sum("m").alias("m"))
    spikes = counts.join(near, "length").withColumn("mean", (F.col("m") - F.col("n")) / 8)
    spikes = spikes.filter((F.col("n") > SPIKE * F.col("mean")) & (F.col("n") - F.col("mean") > DEVIATIONS * F.sqrt(F.col("mean") + 1)))
    return spikes.select("length", F.lit(True).alias("limit"))


def defect_report(found: DataFrame) -> DataFrame:
    return found.groupBy("defect").agg(F.count(F.lit(1)).alias("n_pairs"))


def evidence_report(judged: DataFrame) -> DataFrame:
    """How many truncated answers each kind of evidence speaks for, and for how many it does alone."""
    one = judged.filter(F.col("defect") == "truncated").select(F.explode("evidence").alias("evidence"), (F.size("evidence") == 1).alias("alone"))
    return one.groupBy("evidence").agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("alone").alias("n_alone"))
