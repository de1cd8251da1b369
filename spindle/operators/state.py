"""State kept by events: metrics, latest status, progress of jobs, caches and checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def event_metrics(events: DataFrame) -> DataFrame:
    """Per type: events, users, values; the same plan serves batches and streams in update mode."""
    return events.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("value").isNull()).alias("n_without_value"),
        F.round(F.sum("value"), 2).alias("total"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
    )


def latest_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The last event of each key; of events at the same time the one with the greater id."""
    return events.groupBy(key).agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("e")).select(key, F.col("e.event_type").alias("status"), F.col("e.event_id").alias("event_id"))


def progress(events: DataFrame, milestones: dict[str, int], key: str = "user_id") -> DataFrame:
    """The greatest milestone that the events of a key reached, within 0..100."""
    m = F.create_map(*[F.lit(x) for kv in milestones.items() for x in kv])
    return events.groupBy(key).agg(F.max(F.least(F.greatest(F.coalesce(F.try_element_at(m, F.col("event_type")), F.lit(0)), F.lit(0)), F.lit(100))).alias("progress"))


def to_do(items: DataFrame, cache: DataFrame, keys: list[str]) -> DataFrame:
    """Items that no cache row covers."""
    return items.join(cache.select(*keys).distinct(), keys, "left_anti")


def windowed_counts(events: DataFrame, width: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type in tumbling windows; on a stream with a watermark."""
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    e = e.withWatermark("ts", late) if events.isStreaming else e
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")
