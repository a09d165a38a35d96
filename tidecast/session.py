"""Session set-up and staging of intermediate results."""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A single-machine session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidecast")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("TIDECAST_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers, which need not share the driver's search path."""
    context = spark.sparkContext
    if any(Path(name).name == "tidecast.zip" for name in context.listFiles):
        return
    package = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidecast-")) / "tidecast"
    context.addPyFile(shutil.make_archive(str(target), "zip", package.parent, package.name))


#: Largest size of an Arrow batch on its way to a Python worker.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def limit_batches(spark: SparkSession, size: str = "4m") -> None:
    """Let Arrow batches hold ``size`` bytes instead of 10000 rows, however long, unless the session has a limit.

    Both sides of a worker hold a batch, and Spark's side doubles its buffers to make one.
    """
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, size)


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it gets a fresh temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    context = spark.sparkContext
    if context.getCheckpointDir():
        return context.getCheckpointDir()
    if not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    path = tempfile.mkdtemp(prefix="tidecast-")
    context.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the session's JVM ends."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


#: Removes the shuffle files of a query when it ends, instead of when the driver collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into a table in the shared folder and read it from there.

    Meant for results that several branches read and that are far smaller than what they come from: a lost
    executor must not send the job back to that. Once the table is written, the shuffles behind it are not
    needed any more. The table is deleted when the session's JVM ends.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, "stage")
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)
