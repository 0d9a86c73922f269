"""Sessions for local runs, and the shared folder in which lineage is cut."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_STORED: list[str] = []


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own configuration."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("orelode")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.sql.files.maxPartitionBytes", "8m")  # small local files still fill the cores
        .config("spark.sql.files.openCostInBytes", "64k")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share.

    Where the setting is unset, a local master gets a folder of this machine (tests, notebooks); on a cluster that is an
    error, as the executors would not share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that the executors of {master} share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "orelode-checkpoints")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write df into the shared folder and read it back: cuts lineage, survives the loss of executors.

    by: a column of few values, of which a reader with a filter on it reads only its own.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    _STORED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release_stored(spark: SparkSession) -> int:
    """Delete what ``stored`` has written in this process, once no result that reads it is needed; the number of tables."""
    jvm, n = spark.sparkContext._jvm, len(_STORED)
    while _STORED:
        path = jvm.org.apache.hadoop.fs.Path(_STORED.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    return n
