"""Positions of rows in the files they come from, without sorting the rows.

Rows of one file block get consecutive ids in one task.  Counting the rows of
each block, a table as small as the list of blocks, turns ids into positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_position(scan: DataFrame, name: str, *, per_file: bool) -> DataFrame:
    """Add the position from 0, in each file or through all files in name order."""
    tagged = scan.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    blocks = tagged.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_rows"))
    order: list[Column | str] = ["_block"] if per_file else ["_file", "_block"]
    w = Window.partitionBy("_file") if per_file else Window.partitionBy()
    w = w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "_file", "_block", (F.coalesce(F.sum("_rows").over(w), F.lit(0)) - F.col("_first")).alias("_shift")
    )
    placed = tagged.join(blocks, ["_file", "_block"])
    return placed.withColumn(name, F.col("_id") + F.col("_shift")).drop("_block", "_id", "_shift")
