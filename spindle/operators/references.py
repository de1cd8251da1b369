"""Orphan references: keys that point to records which are missing, deleted or late.

References and parent keys are co-partitioned by key, sorted, and merged linearly (a
sort-merge join, whose skewed partitions AQE splits). Each parent key is first reduced to
its validity: when it was first taken in, and whether its latest version is deleted.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

BLANKS = r"(?U)^[\s​﻿]+|[\s​﻿]+$"


@dataclass(frozen=True)
class ReferenceSource:
    """A table whose records hold references: keys is an ARRAY<STRING> expression, null where there are none."""

    table_name: str
    df: DataFrame
    record_key: Column
    keys: Column
    parent: str


@dataclass(frozen=True)
class ParentSource:
    """A table of parent versions, one row per version."""

    parent: str
    df: DataFrame
    key: Column
    deleted: Column
    ingested_at: Column


def normal_key(key: Column) -> Column:
    """Without surrounding white space, lower case, / for \\ and no leading ./; blank becomes null."""
    k = F.lower(F.regexp_replace(key, BLANKS, ""))
    k = F.regexp_replace(F.translate(k, "\\", "/"), r"^\./", "")
    return F.when(k != "", k)


def records(source: ReferenceSource) -> DataFrame:
    """One row per record: its first arrival, its creation and its distinct normalised keys.

    A record that came in more than once counts once; rows with a null record key hold no record.
    """
    keys = F.array_distinct(F.filter(F.transform(source.keys, normal_key), lambda k: k.isNotNull()))
    return (
        source.df.select(
            F.lit(source.parent).alias("parent"),
            F.lit(source.table_name).alias("table_name"),
            source.record_key.cast("string").alias("record_key"),
            F.col("created_at"),
            F.col("ingested_at"),
            F.array_sort(keys).alias("keys"),
        )
        .filter(F.col("record_key").isNotNull())
        .groupBy("parent", "table_name", "record_key")
        .agg(
            F.min("created_at").alias("created_at"),
            F.min("ingested_at").alias("seen_at"),
            F.array_distinct(F.flatten(F.collect_set("keys"))).alias("keys"),
        )
    )


def validity(source: ParentSource) -> DataFrame:
    """One row per parent key: first arrival and whether the latest version is deleted.

    Among versions that arrived at the same time a deletion counts as the later one. A null
    deletion mark counts as not deleted.
    """
    return (
        source.df.select(
            normal_key(source.key).alias("ref_key"),
            F.coalesce(source.deleted, F.lit(False)).alias("gone"),
            source.ingested_at.alias("at"),
        )
        .filter(F.col("ref_key").isNotNull())
        .groupBy("ref_key")
        .agg(F.min("at").alias("first_at"), F.max(F.struct("at", "gone"))["gone"].alias("gone"))
        .select(F.lit(source.parent).alias("parent"), "ref_key", "first_at", "gone")
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def orphan_references(sources: list[ReferenceSource], parents: list[ParentSource]) -> DataFrame:
    """table_name, record_key, ref_key, status and period (yyyy-MM) of each distinct orphan reference.

    status is the first that applies of missing (no version), deleted (the latest version is
    deleted) and late (the parent first arrived after the record first arrived). Empty tables
    give no rows; with no parent rows every reference is missing. Columns that are not asked
    for are never read, whatever their names.
    """
    refs = _union([records(s) for s in sources]).select(
        "parent", "table_name", "record_key", "created_at", "seen_at", F.explode("keys").alias("ref_key")
    )
    valid = _union([validity(p) for p in parents]).withColumn("known", F.lit(True))
    # the key alone partitions the merge: parent tables differ in few keys, and it is the finest even spread
    merged = refs.join(valid.hint("merge"), ["ref_key", "parent"], "left")
    status = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("gone"), "deleted")
        .when(F.col("first_at") > F.col("seen_at"), "late")
    )
    return (
        merged.withColumn("status", status)
        .filter(F.col("status").isNotNull())
        .select("table_name", "record_key", "ref_key", "status", F.date_format("created_at", "yyyy-MM").alias("period"))
    )


def orphan_report(found: DataFrame) -> DataFrame:
    """Orphan references counted per table, period and status."""
    return found.groupBy("table_name", "period", "status").agg(
        F.count(F.lit(1)).alias("n_references"), F.countDistinct("record_key").alias("n_records")
    )
