"""Sessions, tables by name, and tables written to the shared folder of the cluster."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.utils import is_remote

#: The folder of this process where the cluster names none.
_own: list[str] = []
#: Tables that this process wrote.
_written: list[str] = []


def local_session(cores: int | str = "*", name: str = "spindle", partitions: int = 8) -> SparkSession:
    """A session for tests and benchmarks; on a cluster the caller brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPINDLE_DRIVER_MEMORY", "8g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset a local session, as in tests, gets one of its own; a cluster is refused."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spindle-"))
    return _own[0]


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back.

    The files outlive the loss of executors. clean() removes those of this process, once their results are no longer read.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep(path: str) -> None:
    """Notes a folder of this process, so that clean() removes it."""
    _written.append(path)


def clean(spark: SparkSession) -> int:
    """Removes the tables that this process wrote; how many there were."""
    n = len(_written)
    while _written:
        at = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    return n


def ship(spark: SparkSession) -> str:
    """Sends this package to the executors, once a session, for clusters on which it isn't installed; the path of what was sent."""
    if is_remote():  # a session that only talks to a server has no files to send
        return ""
    sc = spark.sparkContext
    sent = getattr(sc, "_spindle", None)
    if sent is None:
        raw, root = io.BytesIO(), Path(__file__).resolve().parent
        with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"{root.name}/{p.relative_to(root)}")
        # the driver's own file server hands the file out
        folder = tempfile.mkdtemp(prefix="spindle-package-")
        sent = sc._spindle = os.path.join(folder, "spindle.zip")
        Path(sent).write_bytes(raw.getvalue())
        sc.addPyFile(sent)
    return sent
