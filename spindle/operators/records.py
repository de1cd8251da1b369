"""Records from rows: the first or the latest version of each key, and keyed upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def _pick(df: DataFrame, keys: list[str], order: str, pick) -> DataFrame:
    """One row per key by an order; aggregated, so that a key of many versions is reduced before the shuffle."""
    rest = [c for c in df.columns if c not in keys and c != order]
    plain = [c for c in rest if df.schema[c].dataType.typeName() != "map"]
    maps = [c for c in rest if c not in plain]  # maps can't be compared, so they come after what decides
    row = F.struct(*[F.col(c) for c in plain], *[F.col(c) for c in maps])
    chosen = (F.min_by if pick is F.min else F.max_by)(row, F.struct(F.col(order), F.xxhash64(*[F.col(c) for c in plain])))
    out = df.groupBy(*keys).agg(chosen.alias("r"), pick(order).alias(order))
    return out.select(*keys, order, *[F.col("r")[c].alias(c) for c in rest])


def first_version(df: DataFrame, *keys: str, order: str = "ingested_at") -> DataFrame:
    """The row of each key that came in first; rows that came in together are told apart by a hash of what they hold."""
    return _pick(df, list(keys), order, F.min)


def latest_version(df: DataFrame, *keys: str, order: str = "ingested_at") -> DataFrame:
    return _pick(df, list(keys), order, F.max)


def upsert(base: DataFrame, changes: DataFrame, *keys: str, order: str) -> DataFrame:
    """base with the rows of changes; the last version of each key stands."""
    return latest_version(base.unionByName(changes), *keys, order=order)
