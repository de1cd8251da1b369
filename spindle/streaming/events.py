"""Streams over event tables: the batch operators run continuously, with sinks that survive restarts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from spindle.operators.records import latest_version
from spindle.operators.state import event_metrics, progress, windowed_counts
from spindle.session import keep, shared_dir


def event_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    """New files of a folder as they come; a path to one file is the stream of that file."""
    schema = spark.read.parquet(path).schema
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isDirectory()
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    return stream.parquet(path) if folder else stream.option("pathGlobFilter", at.getName()).parquet(path.rpartition("/")[0])


def upsert_sink(df: DataFrame, apply: Callable[[DataFrame, int], None], name: str):
    """Starts a query whose batches go through apply; its checkpoint lies in the shared folder."""
    return df.writeStream.outputMode("update").option("checkpointLocation", f"{shared_dir(df.sparkSession)}/stream-{name}").foreachBatch(apply).trigger(availableNow=True).start()


def streamed(df: DataFrame, name: str, keys: list[str] | None = None) -> DataFrame:
    """Runs a stream to the end of what there is, and the table it leaves in the shared folder.

    Appended results are Parquet files. With keys, results are updates of groups: each batch is
    written with its number, and of each group the row of the last batch stands. Nothing is held by the driver.
    """
    spark = df.sparkSession
    folder = f"{shared_dir(spark)}/stream-{name}-{uuid.uuid4().hex}"
    keep(folder)
    writer = df.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if keys is None:
        q = writer.outputMode("append").format("parquet").option("path", f"{folder}/data").start()
    else:
        q = writer.outputMode("update").foreachBatch(lambda batch, n: batch.withColumn("_batch", F.lit(n).cast("long")).write.mode("overwrite").parquet(f"{folder}/data/batch={n}")).start()
    q.awaitTermination()
    if keys is None:
        return spark.read.schema(df.schema).parquet(f"{folder}/data")
    rows = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_batch", T.LongType())])).option("recursiveFileLookup", True).parquet(f"{folder}/data")
    return latest_version(rows, *keys, order="_batch").select(*df.columns)


def streamed_metrics(spark: SparkSession, path: str, name: str = "event_metrics") -> DataFrame:
    return streamed(event_metrics(event_stream(spark, path)), name, ["event_type"])


def streamed_windows(spark: SparkSession, path: str, name: str = "event_windows") -> DataFrame:
    """Windows are kept as updates; state of windows that the watermark has passed is dropped."""
    return streamed(windowed_counts(event_stream(spark, path)), name, ["window_start", "event_type"])


def streamed_progress(spark: SparkSession, path: str, milestones: dict[str, int], name: str = "event_progress") -> DataFrame:
    return streamed(progress(event_stream(spark, path), milestones), name, ["user_id"])
