"""Building and running evaluation data: generation, judging and answering by given functions, selection, promotion and reports.

Model calls are functions of dictionaries that run in the tasks; what they raise becomes a reason
or an error of the row, never the end of the run.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from spindle.functions.text import clamped
from spindle.operators.evaluation import nearest_rank, retrieval_scores

S = T.StringType()
EVIDENCE = T.ArrayType(T.StructType([T.StructField(n, S) for n in ("chunk_id", "quote", "file_path")]))
MATCH = T.StructType([T.StructField("match", T.BooleanType()), T.StructField("confidence", T.DoubleType()), T.StructField("visible_clues", T.ArrayType(S)), T.StructField("reason", S)])
JUDGE = T.StructType([*[T.StructField(n, T.IntegerType()) for n in ("answer_correctness", "evidence_consistency", "safety", "clarity")], T.StructField("reason", S)])
QUALITY = T.StructType([
    T.StructField("status", S), T.StructField("reason", S), T.StructField("reasons", T.ArrayType(S)), T.StructField("rule_score", T.DoubleType()),
    T.StructField("evidence_score", T.DoubleType()), T.StructField("judge_score", T.IntegerType()), T.StructField("judge", JUDGE),
])
SAMPLE = T.StructType([
    *[T.StructField(n, S) for n in ("id", "task_type", "modality", "question", "image_path", "gold_answer")], T.StructField("evidence", EVIDENCE),
    T.StructField("metadata", T.StructType([T.StructField("core_entity", S), T.StructField("image_match", MATCH)])), T.StructField("quality", QUALITY),
])
#: Criteria of a run (fixed values); the first three named must reach four for a pass.
CRITERIA = ("correctness", "evidence_consistency", "safety", "completeness", "clarity")
#: Reasons for which an image sample may be promoted without being named (fixed values).
PROMOTABLE = ("judge_rejected", "judge_rejected_after_image_rejudge")
REQUIRED = ("question", "gold_answer", "task_type", "modality")


def filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def minimized(samples: DataFrame, judged: bool = True) -> DataFrame:
    """Samples with the fields that are kept, blanks for what is missing; without the judge's marks where they aren't wanted."""
    some = lambda c, v="": F.coalesce(c, F.lit(v))
    q = F.col("quality")
    evidence = F.transform("evidence", lambda e: F.struct(*[some(e[n]).alias(n) for n in ("chunk_id", "quote", "file_path")]))
    quality = [
        some(q["status"], "candidate").alias("status"), some(q["reason"]).alias("reason"), F.when(F.size(q["reasons"]) > 0, q["reasons"]).alias("reasons"),
        some(q["rule_score"], 0.0).alias("rule_score"), some(q["evidence_score"], 0.0).alias("evidence_score"), some(q["judge_score"], 0).alias("judge_score"),
    ]
    return samples.select(
        *[some(F.col(n)).alias(n) for n in ("id", "task_type", "modality", "question")], "image_path", some(F.col("gold_answer")).alias("gold_answer"),
        F.coalesce(evidence, F.array().cast(EVIDENCE)).alias("evidence"),
        F.struct(some(F.col("metadata.core_entity")).alias("core_entity"), F.col("metadata.image_match").alias("image_match")).alias("metadata"),
        F.struct(*quality, *([q["judge"].alias("judge")] if judged else [])).alias("quality"),
    )


def marked_rejected(samples: DataFrame, reasons: Column) -> DataFrame:
    """Samples with reasons (a list) added to theirs, status rejected, and all of them joined as the reason."""
    q = F.col("quality")
    both = F.concat(F.coalesce(q["reasons"], F.array().cast("array<string>")), reasons)
    return samples.withColumn("quality", q.withField("reasons", both).withField("reason", F.array_join(both, "|")).withField("status", F.lit("rejected")))


def as_accepted(samples: DataFrame) -> DataFrame:
    return samples.withColumn("quality", F.col("quality").withField("status", F.lit("accepted")).withField("reason", F.lit("")).withField("reasons", F.lit(None).cast("array<string>")))


def image_match_of(raw: dict | None) -> dict:
    m = raw or {}
    return {"match": bool(m.get("match", False)), "confidence": float(m.get("confidence") or 0.0), "visible_clues": [str(x) for x in m.get("visible_clues") or []], "reason": str(m.get("reason", ""))}


def judge_of(raw: dict | None) -> dict:
    """The four marks within 1..5, three where one is missing or no number, and the reason."""

    def mark(x) -> int:
        try:
            return max(1, min(5, int(x)))
        except (TypeError, ValueError):
            return 3

    j = raw or {}
    return {k: mark(j.get(k)) for k in ("answer_correctness", "evidence_consistency", "safety", "clarity")} | {"reason": str(j.get("reason", "")).strip()}


def built_samples(packs: DataFrame, generate: Callable[[dict], dict], judge: Callable[[dict], dict], known_chunks: DataFrame, verify: Callable[[dict], dict] | None = None) -> DataFrame:
    """Samples generated from packs (sample_id, task, and the columns of a pack), each accepted or rejected with its reasons.

    Images are verified first; what doesn't show its target isn't generated from. A sample is checked
    (0.2 off for each missing field, 0.3 for each unknown chunk) and judged; it stands if its marks
    for the evidence reach three. Each pack gives one sample; errors of a function are its reason.
    """
    ids = known_chunks.select(F.col("chunk_id").alias("known")).distinct()
    e = packs.select("sample_id", F.explode("evidence.chunk_id").alias("c")).join(ids, F.col("c") == F.col("known"), "left").groupBy("sample_id").agg(F.count_if(F.col("known").isNull()).alias("bad"))
    fed = packs.join(e, "sample_id", "left").select(
        "sample_id", "task", F.to_json(F.struct("core_entity", "entity_type", "context", "modality", "expected_entities", "expected_relations", "evidence", *(["image_path"] if "image_path" in packs.columns else []))).alias("pack"),
        F.coalesce("bad", F.lit(0)).alias("bad"),
    )

    def one(sample_id: str, task: str, pack: dict, bad: int) -> dict:
        found = pack.get("evidence") or []
        s = {
            "id": sample_id, "task_type": task, "modality": pack.get("modality"), "question": "", "image_path": pack.get("image_path"), "gold_answer": "",
            "evidence": [{k: x.get(k, "") for k in ("chunk_id", "quote", "file_path")} for x in found], "metadata": {"core_entity": pack.get("core_entity"), "image_match": None},
            "quality": {"status": "candidate", "reason": "", "reasons": None, "rule_score": 0.0, "evidence_score": 0.0, "judge_score": 0, "judge": None},
        }
        q = s["quality"]

        def out(*reasons: str, reason: str | None = None) -> dict:
            q.update(status="rejected", reasons=list(reasons), reason=reason or "|".join(reasons))
            return s

        if pack.get("modality") == "image" and verify is not None:
            try:
                s["metadata"]["image_match"] = image_match_of(verify(pack))
            except Exception as x:  # noqa: BLE001
                return out("generation_error:image_verification_error:" + str(x)[:180], reason="generation_error")
            if not s["metadata"]["image_match"]["match"]:
                return out("image_target_mismatch")
        try:
            made = generate({**pack, "task_type": task, "id": sample_id})
        except Exception as x:  # noqa: BLE001
            return out("generation_error:" + str(x)[:200], reason="generation_error")
        s["question"], s["gold_answer"] = (str(made.get(k, "")).strip() for k in ("question", "gold_answer"))
        missing = [k for k in REQUIRED if not str(s[k] or "").strip()]
        q["rule_score"] = max(0.0, round(1 - 0.2 * len(missing), 4))
        q["evidence_score"] = max(0.0, round(1 - 0.3 * bad, 4)) if found else 0.0
        if missing or bad or not found:
            return out(*[f"missing_{k}" for k in missing], *(["invalid_chunk"] if bad else []), *(["no_evidence"] if not found else []))
        try:
            q["judge"] = judge_of(judge(s))
        except Exception as x:  # noqa: BLE001
            return out("judge_error:" + str(x)[:200])
        q["judge_score"] = sum(v for k, v in q["judge"].items() if k != "reason")
        return s if q["judge"]["evidence_consistency"] >= 3 else out("judge_rejected")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [one(i, t, json.loads(p), int(b)) for i, t, p, b in zip(f["sample_id"], f["task"], f["pack"], f["bad"])]
            yield pd.DataFrame(rows, columns=[x.name for x in SAMPLE])

    return fed.mapInPandas(run, SAMPLE)


def oversampled(quotas: dict[str, int], times: float = 1.5) -> dict[str, int]:
    return {k: max(v, math.ceil(v * times)) for k, v in quotas.items() if v > 0}


def promotable(over_target: bool = False) -> Column:
    reasons = PROMOTABLE + (("over_target_size",) if over_target else ())
    return F.coalesce((F.col("modality") == "image") & F.col("quality.reason").isin(*reasons), F.lit(False)) & filled("question") & filled("gold_answer")


def rejudge_target() -> Column:
    return F.coalesce(F.col("modality") == "image", F.lit(False)) & filled("question") & filled("gold_answer") & filled("image_path")


def demoted_ids(accepted: DataFrame, protected: DataFrame, n: int) -> DataFrame:
    """id of the n text samples with the lowest judge score, later ids first, that aren't protected (id)."""
    judge = F.coalesce(F.col("quality.judge_score"), F.lit(0))
    rest = accepted.filter(~F.coalesce(F.col("modality") == "image", F.lit(False))).join(protected.select("id"), "id", "left_anti")
    return rest.orderBy(judge, F.desc("id")).limit(n).select("id")


def promote(accepted: DataFrame, rejected: DataFrame, ids: DataFrame | None = None, auto: bool = True, keep_size: bool = False, over_target: bool = False) -> tuple[DataFrame, DataFrame]:
    """accepted and rejected once samples named by ids (id) or promotable are moved; with keep_size as many text samples give way.

    A named sample without question or answer is an error, as is a lack of samples that could give way.
    """
    named = ids.select("id").distinct().withColumn("named", F.lit(True)) if ids is not None else rejected.select("id").limit(0).withColumn("named", F.lit(True))
    r = rejected.join(named, "id", "left").withColumn("go", F.coalesce("named", F.lit(False)) | (promotable(over_target) if auto else F.lit(False)))
    bad = r.filter(F.col("go") & ~(filled("question") & filled("gold_answer"))).select("id").limit(5).collect()
    if bad:
        raise ValueError(f"samples without question or answer can't be promoted: {[x[0] for x in bad]}")
    cols = [c for c in rejected.columns]
    up, rest = as_accepted(r.filter("go").select(*cols)), r.filter(~F.col("go")).select(*cols)
    if keep_size:
        n = up.count()
        down = demoted_ids(accepted, up, n)
        if down.count() < n:
            raise ValueError("not enough text samples to give way")
        gone = marked_rejected(accepted.join(down, "id", "left_semi").select(*accepted.columns), F.array(F.lit("over_target_size")))
        accepted, rest = accepted.join(down, "id", "left_anti").select(*accepted.columns), rest.unionByName(gone)
    return accepted.unionByName(up), rest


def with_manifest(rejected: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rejected samples with labels and notes of their image, where the manifest (image_path, labels, notes) has it."""
    m = manifest.groupBy(F.trim("image_path").alias("_path")).agg(F.max(F.struct("notes", "labels")).alias("_m"))
    return rejected.join(m, F.trim("image_path") == F.col("_path"), "left").withColumn("labels", F.col("_m.labels")).withColumn("notes", F.coalesce("_m.notes", F.lit(""))).drop("_path", "_m")


def rejudged(rejected: DataFrame, manifest: DataFrame, verify: Callable[[dict], dict], judge: Callable[[dict], dict]) -> DataFrame:
    """Rejected samples with outcome: promoted, still_rejected, error (the row is as it was) or untouched, by verifying and judging image samples anew."""
    fed = with_manifest(rejected, manifest).withColumn("target", rejudge_target())

    def one(s: dict) -> tuple[str, dict, dict]:
        match = image_match_of(verify(s))
        if not match["match"]:
            return "image_target_mismatch_after_image_rejudge", match, None
        j = judge_of(judge(s))
        return ("" if j["evidence_consistency"] >= 3 else "judge_rejected_after_image_rejudge"), match, j

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for key, text in zip(f["id"], f["sample"]):
                try:
                    reason, match, j = one(json.loads(text))
                    out.append((key, "still_rejected" if reason else "promoted", reason, match, j, ""))
                except Exception as x:  # noqa: BLE001
                    out.append((key, "error", "", None, None, str(x)[:300]))
            yield pd.DataFrame(out, columns=["id", "outcome", "new_reason", "new_match", "new_judge", "error"])

    schema = T.StructType([*[T.StructField(n, S) for n in ("id", "outcome", "new_reason")], T.StructField("new_match", MATCH), T.StructField("new_judge", JUDGE), T.StructField("error", S)])
    told = F.to_json(F.struct("id", "question", "gold_answer", "image_path", "evidence", "labels", "notes"))
    new = fed.filter("target").select("id", told.alias("sample")).mapInPandas(run, schema)
    both = rejected.join(new, "id", "left").withColumn("outcome", F.coalesce("outcome", F.lit("untouched")))
    q, j = F.col("quality"), F.col("new_judge")
    total = j["answer_correctness"] + j["evidence_consistency"] + j["safety"] + j["clarity"]
    judged = F.when(j.isNotNull(), q.withField("judge", j).withField("judge_score", total)).otherwise(q)
    up = judged.withField("status", F.lit("accepted")).withField("reason", F.lit("")).withField("reasons", F.lit(None).cast("array<string>"))
    reasons = F.concat(F.coalesce(q["reasons"], F.array().cast("array<string>")), F.array("new_reason"))
    down = judged.withField("reasons", reasons).withField("reason", F.array_join(reasons, "|")).withField("status", F.lit("rejected"))
    quality = F.when(F.col("outcome") == "promoted", up).when(F.col("outcome") == "still_rejected", down).otherwise(q)
    match = F.when(F.col("new_match").isNotNull(), F.col("metadata").withField("image_match", F.col("new_match"))).otherwise(F.col("metadata"))
    return both.withColumn("quality", quality).withColumn("metadata", match).select(*rejected.columns, "outcome", "error")


def manifest_rows(images: DataFrame, describe: Callable[[dict], dict], placeholder: str, choices: tuple[str, ...], other: str) -> DataFrame:
    """image_path, labels, notes, metadata of images whose name tells crop, target and number; failed names and calls come out with an error.

    A crop that is the placeholder becomes what describe says, if that is one of choices, else other.
    """

    def row(path: str) -> tuple:
        parts = [x.strip() for x in path.rpartition("/")[2].rpartition(".")[0].replace("-", "_").split("_") if x.strip()]
        if len(parts) < 3:
            raise ValueError("a name has crop, target and number")
        crop, target, number = parts[0], parts[1], "_".join(parts[2:])
        told = describe({"image_path": path, "crop": crop, "target": target})
        words = lambda x: [str(y).strip() for y in (x if isinstance(x, list) else [x] if x else []) if str(y).strip()]
        clues = words(told.get("visible_clues"))
        guess = str(told.get("crop", "")).strip()
        real = (guess if guess in choices else other) if crop.lower() == placeholder else crop
        sure = min(1.0, max(0.0, float(told.get("confidence") or 0.0)))
        return path, real, target, words(told.get("symptoms")), str(told.get("notes", "")).strip() or "；".join(clues[:4]), number, crop.lower() == placeholder, sure, ""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for path in f["image_path"]:
                try:
                    out.append(row(path))
                except Exception as x:  # noqa: BLE001
                    out.append((path, None, None, None, None, None, None, None, str(x)[:500]))
            yield pd.DataFrame(out, columns=["image_path", "crop", "target", "symptoms", "notes", "number", "inferred", "confidence", "error"])

    return images.select("image_path").mapInPandas(run, "image_path string, crop string, target string, symptoms array<string>, notes string, number string, inferred boolean, confidence double, error string")


RESULT = "id string, task_type string, modality string, system_answer string, latency_sec double, gold array<string>, found array<string>, judge map<string,int>, total_score int, pass boolean, error string"


def evaluated(samples: DataFrame, answer: Callable[[dict], dict], judge: Callable[[dict, str], dict] | None = None, clock: Callable[[], float] | None = None) -> DataFrame:
    """A row of results for each sample: answer (a function that gives answer and chunk_ids), marks, retrieval scores, or the error cut to 500 characters.

    With judge, five criteria within 1..5 are summed; correctness, evidence and safety must reach four for a pass.
    """
    fed = samples.select("id", "task_type", "modality", F.to_json(F.struct("id", "question", "gold_answer", "image_path", "modality")).alias("sample"), F.filter("evidence.chunk_id", lambda c: F.coalesce(c, F.lit("")) != "").alias("gold"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import time

        now = clock or time.perf_counter
        mark = lambda x: max(1, min(5, int(x))) if str(x).lstrip("-").isdigit() else 3
        for f in frames:
            out = []
            for key, task, modality, text, gold in zip(f["id"], f["task_type"], f["modality"], f["sample"], f["gold"]):
                began, s = now(), json.loads(text)
                try:
                    a = answer(s)
                    said, took = str(a.get("answer", "")).strip(), round(now() - began, 4)
                    marks = {k: mark((got := judge(s, said) or {}).get(k, 3)) for k in CRITERIA} if judge else None
                    ok = all(marks[k] >= 4 for k in CRITERIA[:3]) if marks else None
                    out.append((key, task, modality, said, took, gold, list(a.get("chunk_ids") or []), marks, sum(marks.values()) if marks else None, ok, ""))
                except Exception as x:  # noqa: BLE001
                    out.append((key, task, modality, "", round(now() - began, 4), gold, [], None, None, False, str(x)[:500] or type(x).__name__))
            yield pd.DataFrame(out, columns=["id", "task_type", "modality", "system_answer", "latency_sec", "gold", "found", "judge", "total_score", "pass", "error"])

    return retrieval_scores(fed.mapInPandas(run, RESULT))


def mean(c: Column) -> Column:
    """Rounded to four places, 0 where there is nothing."""
    return F.coalesce(F.round(F.avg(c), 4), F.lit(0.0))


def run_report(results: DataFrame, key: str) -> DataFrame:
    """Per value of key: samples, success, errors, share that passed among those without error, means of all marks, of retrieval and of latency."""
    ok = F.coalesce(F.col("error"), F.lit("")) == ""
    good = lambda c: F.when(ok, F.coalesce(c, F.lit(0)).cast("double"))
    n_ok = F.count_if(ok)
    marks = [mean(good(F.try_element_at("judge", F.lit(c)))).alias(f"avg_{c}") for c in CRITERIA]
    passed = F.round(F.count_if(ok & F.coalesce(F.col("pass"), F.lit(False))) / F.greatest(n_ok, F.lit(1)), 4)
    return results.groupBy(F.coalesce(F.col(key), F.lit("")).alias(key)).agg(
        F.count(F.lit(1)).alias("samples"), n_ok.alias("success"), (F.count(F.lit(1)) - n_ok).alias("error_count"), passed.alias("pass_rate"),
        mean(good(F.col("total_score"))).alias("avg_total_score"), *marks, mean(good(F.col("recall"))).alias("avg_recall"), mean(good(F.col("precision"))).alias("avg_precision"),
        mean(good(F.col("f1"))).alias("avg_f1"), mean(good(F.col("latency_sec"))).alias("avg_latency_sec"),
    )


def run_summary(results: DataFrame) -> DataFrame:
    """One row: what run_report tells of all samples, with the latency of rank floor(n * 0.95)."""
    everything = run_report(results.withColumn("run", F.lit("all")), "run")
    ok = results.filter(F.coalesce(F.col("error"), F.lit("")) == "").select(F.lit("all").alias("run"), "latency_sec")
    p95 = nearest_rank(ok, "run", "latency_sec").select("run", F.round("at_rank", 4).alias("p95_latency_sec"))
    return everything.join(p95, "run", "left").withColumn("p95_latency_sec", F.coalesce("p95_latency_sec", F.lit(0.0)))


def build_report(accepted: DataFrame, rejected: DataFrame, n_candidates: int | Column) -> DataFrame:
    """part, name, n, rank, value: counts and rates, distributions of what was accepted (the 20 most frequent entities and chunks), reasons of what was rejected, mean scores.

    Of equal counts the smaller name comes first. Blank values don't count.
    """
    t = lambda c: F.trim(F.col(c))
    a = accepted.select(
        F.explode(F.array(
            F.struct(F.lit("task_type").alias("part"), t("task_type").alias("name")), F.struct(F.lit("modality").alias("part"), t("modality").alias("name")), F.struct(F.lit("core_entity").alias("part"), t("metadata.core_entity").alias("name")),
        )).alias("e")
    ).select("e.*").unionByName(accepted.select(F.lit("evidence_chunk").alias("part"), F.explode("evidence.chunk_id").alias("name"))).unionByName(
        rejected.select(F.lit("rejection_reason").alias("part"), F.explode("quality.reasons").alias("name"))
    )
    counted = a.filter(F.coalesce("name", F.lit("")) != "").groupBy("part", "name").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("n"), "name"))
    limited = counted.filter(F.col("part").isin("core_entity", "evidence_chunk")).withColumn("rank", r).filter(F.col("rank") <= 20)
    rest = counted.filter(~F.col("part").isin("core_entity", "evidence_chunk")).withColumn("rank", F.lit(None).cast("int"))
    both = limited.unionByName(rest).withColumn("value", F.lit(None).cast("double"))
    total = F.lit(n_candidates) if isinstance(n_candidates, int) else n_candidates
    q = F.col("quality")
    agg = accepted.agg(F.count(F.lit(1)).alias("accepted"), mean(q["rule_score"]).alias("rule"), mean(q["evidence_score"]).alias("evidence"), mean(q["judge_score"]).alias("judge"))
    agg = agg.withColumn("one", F.lit(1)).join(rejected.agg(F.count(F.lit(1)).alias("rejected")).withColumn("one", F.lit(1)), "one")
    agg = agg.withColumn("candidates", total.cast("long"))
    row = lambda part, name, n=None, value=None: F.struct(F.lit(part).alias("part"), F.lit(name).alias("name"), (n if n is not None else F.lit(None)).cast("long").alias("n"), (value if value is not None else F.lit(None)).cast("double").alias("value"))
    rate = F.round(F.col("accepted") / F.greatest(F.lit(1), "candidates"), 4)
    head = agg.select(F.explode(F.array(
        row("counts", "candidates", F.col("candidates")), row("counts", "accepted", F.col("accepted")), row("counts", "rejected", F.col("rejected")), row("counts", "acceptance_rate", None, rate),
        row("quality", "avg_rule_score", None, F.col("rule")), row("quality", "avg_evidence_score", None, F.col("evidence")), row("quality", "avg_judge_score", None, F.col("judge")),
    )).alias("e")).select("e.part", "e.name", "e.n", F.lit(None).cast("int").alias("rank"), "e.value")
    return head.unionByName(both)


def five_marks(judge: Column) -> Column:
    """total and pass of marks by five criteria, each within 1..5, three where missing."""
    c = {k: clamped(judge[k]) for k in CRITERIA}
    return F.struct(sum(c.values(), F.lit(0)).alias("total"), ((c["correctness"] >= 4) & (c["evidence_consistency"] >= 4) & (c["safety"] >= 4)).alias("pass"))
