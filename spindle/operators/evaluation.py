"""Evaluation data: evidence, quotes, tasks, selection, scores and reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from spindle.functions.text import clamped


def evidence_rows(packs: DataFrame, key: str) -> DataFrame:
    """One row per item of evidence, in order."""
    return packs.select(key, F.posexplode("evidence").alias("position", "e")).select(key, "position", "e.*")


def evidence_chunks(packs: DataFrame, chunks: DataFrame, key: str) -> DataFrame:
    """Evidence whose chunk exists and has content: key, position, chunk_id, page_idx, length of the content."""
    rows = evidence_rows(packs, key).select(key, "position", "chunk_id")
    told = chunks.filter(F.trim("content") != "").select("chunk_id", "page_idx", F.length("content").alias("n_chars"))
    return rows.join(told, "chunk_id")


def scaled_quotas(base: dict[str, int], total: int) -> dict[str, int]:
    """Quotas in the proportions of base that add up to total: rounded, the rest dealt out from the greatest on."""
    whole = sum(base.values()) or 1
    out = {k: round(total * v / whole) for k, v in base.items()}
    order = sorted(base, key=lambda k: (-base[k], k))
    i = 0
    while order and sum(out.values()) != total:
        k = order[i % len(order)]
        step = 1 if sum(out.values()) < total else -1
        if out[k] + step >= 0:
            out[k] += step
        i += 1
    return out


def select_accepted(samples: DataFrame, target: int, image_ratio: float = 0.0) -> DataFrame:
    """id, accepted: the best by judge and evidence score, among them at least so many images as there are and the ratio asks for."""
    judge = F.coalesce(F.col("judge_score"), F.lit(0)).cast("int")
    order = [F.desc(judge), F.desc(F.coalesce(F.col("evidence_score"), F.lit(0.0))), F.col("id")]
    images = min(target, math.ceil(target * max(0.0, image_ratio)))
    image = F.coalesce(F.col("modality") == "image", F.lit(False))
    # ranks within few leading rows: a top-k each, not a sort of everything in one task
    lead = samples.filter(image).orderBy(*order).limit(images).select("id")
    n = lead.count()
    rest = samples.join(lead, "id", "left_anti").orderBy(*order).limit(max(0, target - n)).select("id")
    chosen = lead.unionByName(rest).withColumn("accepted", F.lit(True))
    return samples.select("id").join(chosen, "id", "left").select("id", F.coalesce("accepted", F.lit(False)).alias("accepted"))


def retrieval_scores(pairs: DataFrame, gold: str = "gold", found: str = "found") -> DataFrame:
    """hit, recall, precision and f1 of two lists of ids, rounded to four places; 0 where there is nothing to divide by."""
    g, p = F.array_distinct(gold), F.array_distinct(found)
    both = F.size(F.array_intersect(g, p))
    share = lambda n, d: F.when(d > 0, F.round(n / d, 4)).otherwise(0.0)
    recall, precision = both / F.size(g), both / F.size(p)
    f1 = F.when(both > 0, F.round(2 * recall * precision / (recall + precision), 4)).otherwise(0.0)
    return pairs.withColumn("hit", (both > 0).cast("int")).withColumn("recall", share(both, F.size(g))).withColumn("precision", share(both, F.size(p))).withColumn("f1", f1)


def judge_totals(samples: DataFrame) -> DataFrame:
    """The four criteria clamped to 1..5 (3 where missing), their sum, and whether the evidence holds."""
    c = {k: clamped(F.col("quality")["judge"][k]) for k in ("answer_correctness", "evidence_consistency", "safety", "clarity")}
    total = c["answer_correctness"] + c["evidence_consistency"] + c["safety"] + c["clarity"]
    return samples.select("id", *[v.alias(k) for k, v in c.items()], total.alias("total"), (c["evidence_consistency"] >= 3).alias("passed"))


def validation_scores(samples: DataFrame, chunks: DataFrame, key: str = "id", required: tuple[str, ...] = ("question", "gold_answer", "task_type", "modality")) -> DataFrame:
    """rule_score: 1 less 0.2 a missing field; evidence_score: 1 less 0.3 an unknown chunk, 0 without evidence; none below 0."""
    missing = sum(((F.trim(F.coalesce(F.col(f), F.lit(""))) == "").cast("int") for f in required), F.lit(0))
    rows = evidence_rows(samples, key)
    bad = rows.join(chunks.select("chunk_id"), "chunk_id", "left_anti").groupBy(key).agg(F.count(F.lit(1)).alias("bad"))
    floor = lambda x: F.greatest(F.lit(0.0), F.round(x, 4))
    base = samples.select(key, missing.alias("missing"), F.coalesce(F.size("evidence"), F.lit(0)).alias("n")).join(bad, key, "left")
    return base.select(key, floor(1 - 0.2 * F.col("missing")).alias("rule_score"), F.when(F.col("n") <= 0, 0.0).otherwise(floor(1 - 0.3 * F.coalesce("bad", F.lit(0)))).alias("evidence_score"))


def dataset_report(samples: DataFrame) -> DataFrame:
    """part, name, n: how often each task, modality, entity, file and reason occurs; blanks don't count."""
    t = lambda c: F.trim(c)
    parts = {
        "task_type": F.array(t(F.col("task_type"))), "modality": F.array(t(F.col("modality"))), "core_entity": F.array(t(F.col("metadata.core_entity"))),
        "file": F.array_distinct(F.transform("evidence", lambda e: e["file_path"])), "reason": F.split(F.col("quality.reason"), r"\|"),
    }

    def entry(part: str):
        return lambda x: F.struct(F.lit(part).alias("part"), x.alias("name"))

    entries = F.flatten(F.array(*[F.transform(F.coalesce(v, F.array().cast("array<string>")), entry(k)) for k, v in parts.items()]))
    e = samples.select(F.explode(entries).alias("e")).select("e.*").filter(F.col("name").isNotNull() & (F.trim("name") != ""))
    return e.groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))


def group_report(samples: DataFrame, key: str) -> DataFrame:
    """Per value of key: samples, how many passed, means of judge and evidence scores."""
    q = F.col("quality")
    return samples.groupBy(F.coalesce(F.trim(key), F.lit("")).alias(key)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(q["status"] == "accepted").alias("n_accepted"), F.round(F.avg(q["judge_score"]), 4).alias("mean_judge"),
        F.round(F.avg(q["evidence_score"]), 4).alias("mean_evidence"), F.max(q["rule_score"]).alias("best_rule"),
    )


def nearest_rank(df: DataFrame, by: str, value: str, share: float = 0.95) -> DataFrame:
    """by, n, mean and the value of rank floor(n * share), at least the first, found by counting equal values."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("c"))
    n = counted.groupBy(by).agg(F.sum("c").alias("n"), (F.sum(F.col(value) * F.col("c")) / F.sum("c")).alias("mean"))
    upto = counted.withColumn("upto", F.sum("c").over(Window.partitionBy(by).orderBy(value)))
    rank = F.greatest(F.lit(1), F.floor(F.col("n") * share))
    found = upto.join(n, by).filter(F.col("upto") >= rank).groupBy(by).agg(F.min(value).alias("at_rank"))
    return n.join(found, by).select(by, "n", F.round("mean", 4).alias("mean"), "at_rank")


def review_sheet(samples: DataFrame) -> DataFrame:
    """Flat rows of fourteen columns for reviewers: chunks and reasons joined by strokes, blanks for what a sample doesn't have, room for a decision."""
    q, m, have = F.col("quality"), F.col("metadata"), set(samples.schema["metadata"].dataType.fieldNames())
    some = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    part = lambda n: some(m[n]) if n in have else F.lit("")
    level = some(F.col("difficulty")) if "difficulty" in samples.columns else F.lit("")
    chunk = F.array_join(F.transform(F.coalesce("evidence", F.array().cast(samples.schema["evidence"].dataType)), lambda e: F.coalesce(e["chunk_id"], F.lit(""))), "|")
    return samples.select(
        some(F.col("id")).alias("id"), some(q["status"]).alias("status"), some(F.col("task_type")).alias("task_type"), some(F.col("modality")).alias("modality"), level.alias("difficulty"), part("core_entity").alias("core_entity"),
        part("entity_type").alias("entity_type"), some(F.col("question")).alias("question"), some(F.col("gold_answer")).alias("gold_answer"), chunk.alias("evidence_chunks"), some(q["judge_score"]).alias("judge_score"),
        F.coalesce(F.array_join(q["reasons"], "|"), F.lit("")).alias("reasons"), F.lit("").alias("manual_decision"), F.lit("").alias("manual_notes"),
    )


def flattened(c: Column, kind, prefix: str) -> list[Column]:
    """All plain fields of a struct of any depth, under the names of the way to them; lists joined by strokes."""
    out = []
    for f in kind.fields:
        name, x = f"{prefix}_{f.name}" if prefix else f.name, c[f.name] if c is not None else F.col(f.name)
        if f.dataType.typeName() == "struct":
            out += flattened(x, f.dataType, name)
        elif f.dataType.typeName() == "array":
            out.append(F.array_join(x.cast("array<string>"), "|").alias(name))
        else:
            out.append(x.alias(name))
    return out


def flat_evidence(samples: DataFrame) -> DataFrame:
    """One row per item of evidence, one for samples without any; every field of a sample, its quality and metadata is a column, in the order of names."""
    item = samples.schema["evidence"].dataType.elementType
    e = samples.withColumn("evidence", F.explode_outer("evidence"))
    cols = [c for n in samples.columns if n not in ("evidence", "quality", "metadata") for c in [F.col(n)]]
    cols += flattened(F.col("evidence"), item, "evidence")
    for n in ("quality", "metadata"):
        if n in samples.columns:
            cols += flattened(F.col(n), samples.schema[n].dataType, n)
    out = e.select(*cols)
    return out.select(*sorted(out.columns))


def sample_ids(samples: DataFrame, key: str, group: str) -> DataFrame:
    """key, sample_id: group and running number within it, numbered in the order of a hash of key, bucket by bucket, so that no group is ranked in one task."""
    s = samples.select(key, group, F.md5(F.col(key).cast("string")).alias("h")).withColumn("bucket", F.substring("h", 1, 3))
    sizes = s.groupBy(F.col(group).alias("_g"), F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("_g").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    r = F.row_number().over(Window.partitionBy(group, "bucket").orderBy("h", key))
    same = F.col(group).eqNullSafe(F.col("_g")) & (F.col("bucket") == F.col("_b"))
    out = s.withColumn("r", r).join(sizes.withColumn("before", before), same)
    return out.select(key, F.concat_ws("_", F.col(group), F.lpad((F.col("before") + F.col("r")).cast("string"), 8, "0")).alias("sample_id"))
