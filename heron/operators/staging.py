"""Intermediate rows in the folder that driver and executors share, and broadcasts of counted sides."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest side, in rows of a few integers, that is broadcast after it has been counted.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share. Where none is set, a local session gets a temporary one; on a cluster that is an error, as executors don't share such a folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="heron-"))
    return sc.getCheckpointDir()


def saved(df: DataFrame) -> DataFrame:
    """Small intermediate rows, computed once and kept in the shared folder; with spark.cleaner.referenceTracking.cleanCheckpoints Spark removes them when they are no longer used."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Wide intermediate rows as a Parquet table in the shared folder, so that later steps read only the columns they need."""
    path = f"{shared_dir(df.sparkSession)}/heron-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder)


def remove(spark: SparkSession, path: str) -> None:
    """A folder of intermediate rows that are no longer read, by the file system that it is in."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores if it is read in fewer parts than that, as a small file with one row group is; else as it is. For heavy work by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to be small; else as it is, for a shuffled join. Use on saved rows."""
    return F.broadcast(df) if df.count() <= limit else df
