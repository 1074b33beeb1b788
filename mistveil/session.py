"""Session defaults for local runs. On a cluster the submitted configuration wins."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | None = None, app: str = "mistveil", shuffle: int | None = None) -> SparkSession:
    """A local[N] session with the settings that the tests and bench.py use."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    return (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.shuffle.partitions", str(shuffle or n))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def spread(df: DataFrame) -> DataFrame:
    """df over all cores, for row-by-row work that is far dearer than a shuffle of its input.

    A file is read by as many tasks as it has row groups, so a small table of one row group keeps one core busy. Only inputs that
    could not fill the cores with partitions of the configured size are dealt out; larger ones stay as they are read, without a shuffle.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    whole = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(2 * cores) if size < cores * whole else df


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or an own one where that is unset and all run in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="mistveil-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")
