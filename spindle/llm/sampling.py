"""A sample whose shares match given targets, with a minimum per category and a report of deficits.

Each record gets a fixed pseudo-random number u in [0, 1) from its key and target. A category accepts
its records independently with the probability p = (quota + margin) / observed, where the margin
makes too few acceptances rare; all others are dropped where they are read, before anything is
shuffled. The accepted are then corrected exactly: the quota-th smallest u of each category is found
from a histogram over u/p, and only the records of the one bucket that holds it are ranked. Where
too few were accepted (which is counted) the missing ones are taken in the same order from those that
weren't. No category is ever gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from spindle.session import written

BUCKETS = 4096
#: What is accepted beyond the quota, in the mean: so many times its root, and so many.
MARGIN = (6, 16)
WHITE = r"(?U)^\s+|\s+$"


def trimmed(c: Column) -> Column:
    """Without surrounding white space of any kind, the ideographic space included."""
    return F.regexp_replace(c, WHITE, "")


@dataclass
class Source:
    """A table to sample: its name in the targets, its key and the fields that make the category."""

    name: str
    df: DataFrame
    key: str
    fields: list[str] = field(default_factory=list)


@dataclass
class TargetSample:
    """sample: source_table, target_id, record_key. report: one row per target, with what the sample holds of it."""

    sample: DataFrame
    report: DataFrame


def distinct_records(source: Source) -> DataFrame:
    """One row per key (of its first arrival), with the trimmed category fields as fields."""
    category = F.array(*[trimmed(F.col(f)) for f in source.fields])
    return (
        source.df.select(F.col(source.key).cast("string").alias("record_key"), "ingested_at", category.alias("category"))
        .filter(F.col("record_key").isNotNull())
        .groupBy("record_key")
        .agg(F.min(F.struct("ingested_at", "category"))["category"].alias("category"))
        .select(F.lit(source.name).alias("source_table"), "record_key", "category")
    )


def uniform(seed: int) -> Column:
    """A number in [0, 1) that follows from key, target and seed: 52 bits of a hash that other engines have too."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", "record_key", F.col("target_id").cast("string"), F.lit(str(seed)))), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def _smallest(drawn: DataFrame, at: Column) -> DataFrame:
    """source_table, target_id, record_key of the quota rows of each target with the smallest u; at spreads u over [0, 1)."""
    drawn = drawn.withColumn("bucket", F.greatest(F.lit(0), F.least(F.floor(at * BUCKETS), F.lit(BUCKETS))).cast("int"))
    before = Window.partitionBy("target_id").orderBy("bucket")
    cut = (
        drawn.groupBy("target_id", "quota", "bucket").agg(F.count(F.lit(1)).alias("here"))
        .withColumn("upto", F.sum("here").over(before))
        .filter(F.col("upto") - F.col("here") < F.col("quota"))
        .select("target_id", "bucket", F.when(F.col("upto") > F.col("quota"), F.col("quota") - F.col("upto") + F.col("here")).alias("part"))
    )
    kept = drawn.join(cut, ["target_id", "bucket"])
    rank = F.row_number().over(Window.partitionBy("target_id").orderBy("u", "record_key"))
    last = kept.filter(F.col("part").isNotNull()).withColumn("rank", rank).filter(F.col("rank") <= F.col("part"))
    cols = ["source_table", "target_id", "record_key"]
    return kept.filter(F.col("part").isNull()).select(cols).unionByName(last.select(cols))


def sample_by_targets(sources: list[Source], targets: DataFrame, seed: int = 17, name: str = "sample") -> TargetSample:
    """Samples every source by the rows of targets that name it.

    A record belongs to a target if all category fields equal the target's after trimming; a
    null field belongs to none. N counts all distinct records, those of no category included.
    sample_rows = floor(sample_permille * N / 1000); quota = max(min_rows, floor(target_permille
    * sample_rows / 1000)). A category with fewer records than its quota gives all of them and
    has a deficit. Records sent twice count once; empty sources give a deficit for each target
    with a quota. Targets that repeat a category each draw their own sample.
    """
    everything, wanted = None, None
    for s in sources:
        r = distinct_records(s)
        w = targets.filter(F.col("source_table") == s.name).select(
            "source_table", "target_id", F.array(*[trimmed(F.col(f)) for f in s.fields]).alias("category"),
            "target_permille", "min_rows", "sample_permille",
        )
        everything = r if everything is None else everything.unionByName(r)
        wanted = w if wanted is None else wanted.unionByName(w)
    full = ~F.exists("category", lambda x: x.isNull())
    records = written(everything, f"{name}-records")
    n = records.groupBy("source_table").agg(F.count(F.lit(1)).alias("n"))
    seen = (
        records.filter(full).groupBy("source_table", "category").agg(F.count(F.lit(1)).alias("observed"))
        .join(wanted.select("source_table", "category", "target_id"), ["source_table", "category"])
        .select("target_id", "observed")
    )
    rows = F.floor(F.col("sample_permille").cast("long") * F.coalesce("n", F.lit(0)) / 1000)
    quotas = (
        wanted.join(n, "source_table", "left").join(seen, "target_id", "left")
        .select(
            "source_table", "target_id", "category",
            F.coalesce("n", F.lit(0)).alias("n_records"), F.coalesce("observed", F.lit(0)).alias("observed"),
            F.greatest(F.col("min_rows").cast("long"), F.floor(F.col("target_permille").cast("long") * rows / 1000)).alias("quota"),
        )
        .withColumn("p", F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("quota") + MARGIN[0] * F.sqrt("quota") + MARGIN[1]) / F.greatest("observed", F.lit(1))))
    )
    quotas = written(quotas, f"{name}-quotas")
    # the table of quotas is as small as that of targets; being written, its size is known
    offered = records.filter(full).join(quotas.select("source_table", "category", "target_id", "quota", "p"), ["source_table", "category"]).withColumn("u", uniform(seed))
    accepted = written(offered.filter(F.col("u") < F.col("p")).select("source_table", "target_id", "record_key", "u", "p", "quota"), f"{name}-accepted")
    chosen = _smallest(accepted, F.col("u") / F.col("p"))
    n_accepted = accepted.groupBy("target_id").agg(F.count(F.lit(1)).alias("n_accepted"))
    short = written(
        quotas.join(n_accepted, "target_id", "left").withColumn("lack", F.least("quota", "observed") - F.coalesce("n_accepted", F.lit(0))).filter(F.col("lack") > 0).select("target_id", F.col("lack").alias("quota"), "p"),
        f"{name}-short",
    )
    refused = offered.filter(F.col("u") >= F.col("p")).select("source_table", "target_id", "record_key", "u").join(short, "target_id")
    more = _smallest(refused, (F.col("u") - F.col("p")) / (1 - F.col("p")))
    sample = written(chosen.unionByName(more), f"{name}-sample")
    taken = sample.groupBy("target_id").agg(F.count(F.lit(1)).alias("sampled"))
    sampled = F.coalesce("sampled", F.lit(0))
    report = quotas.join(taken, "target_id", "left").select(
        "source_table", "target_id", "n_records", "observed", "quota", sampled.alias("sampled"), (F.col("quota") - sampled).alias("deficit")
    )
    return TargetSample(sample, report)


def deficits(report: DataFrame) -> DataFrame:
    """target_id of each target whose category holds fewer records than its quota."""
    return report.filter(F.col("deficit") > 0).select("target_id")
