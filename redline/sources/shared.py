"""Intermediate tables in the folder that all machines of the cluster share."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Only a session that runs in one process may do without: it gets a folder
    below the temporary directory.  On a cluster each machine would have its
    own, so a missing setting is an error at once.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if folder:
        return folder
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="run-checkpoints-")
    sc.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, prefix: str = "redline") -> str:
    """A path of its own below the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{prefix}-{uuid.uuid4().hex}"


def keep(df: DataFrame) -> DataFrame:
    """Write a result that several branches read and go on from the written table.

    A lost executor then costs no recomputation; unlike a checkpoint, the
    table also tells the optimizer its size.  The shuffle files of the jobs that
    made it are no longer needed, so Spark's cleaner is asked to look for them.
    """
    spark = df.sparkSession
    path = new_folder(spark)
    df.write.parquet(path)
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def keep_narrow(df: DataFrame) -> DataFrame:
    """As ``keep``, for short tables out of small shuffles: an eighth of the shuffle's partitions, so not many tiny files."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions")) // 8
    return keep(df.coalesce(max(spark.sparkContext.defaultParallelism, parts)))
