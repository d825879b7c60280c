"""JSON lines: tolerant reading with line numbers, and appending."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions import modeltext as M
from redline.functions import text as X
from redline.sources import numbering, storage

_EMPTY = "file string, line_no bigint, value string, corrupt boolean"


def read_tolerant(spark: SparkSession, path: str) -> DataFrame:
    """(file, line_no, value, corrupt) of all lines that are not blank.

    Line numbers count from 1 in each file.  A path that does not exist is empty.
    """
    if not storage.exists(spark, path):
        return spark.createDataFrame([], _EMPTY)
    d = numbering.with_position(spark.read.text(str(path)), "line_no", per_file=True)
    d = d.select(
        F.col("_file").alias("file"), (F.col("line_no") + 1).alias("line_no"), X.strip(F.col("value")).alias("value")
    ).where("value <> ''")
    return d.withColumn("corrupt", ~M.is_json(F.col("value")))


def append(df: DataFrame, path: str) -> None:
    """Add rows; the files of one call become visible together or not at all."""
    df.write.mode("append").option("ignoreNullFields", False).json(str(path))
