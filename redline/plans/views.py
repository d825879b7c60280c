"""Predictions and failures of a run, kept up to date range by range.

The latest state lies in ranges of ``rows`` case rows.  A batch rewrites the
ranges of its own cases, in the state and in both CSV folders, so that what it
writes follows the batch and not the run.  The state here belongs to one run: it
is built from the log when the run starts, and the log stays what counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import constants as K
from redline.operators import checkpoint as C
from redline.sources import csv, storage
from redline.sources.shared import keep, new_folder

#: ``place`` is the row of the case; cases that the run does not know have none and lie in the range -1.
_SCHEMA = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in C.RECORD.fields)
_SCHEMA = f"{_SCHEMA}, seq long, place long, first_seq long, part long"
_PREDICTIONS = ("case_id", "report")


class Views:
    def __init__(self, spark: SparkSession, cases: DataFrame, predictions: str, failures: str, rows: int = 10_000):
        self.spark, self.cases, self.rows = spark, cases, rows
        self.predictions, self.failures = predictions, failures
        self.folder: str | None = None

    # --- state ----------------------------------------------------------------

    def _part(self) -> Column:
        return F.coalesce(F.floor(F.col("place") / self.rows), F.lit(-1)).cast("long")

    def _placed(self, records: DataFrame) -> DataFrame:
        return records.join(self.cases.select("case_id", F.col("row_index").alias("place")), "case_id", "left")

    def _read(self, parts: list[int] | None = None) -> DataFrame:
        if self.folder is None:
            raise ValueError("rebuild comes first")
        paths = [self.folder]
        if parts is not None:
            paths = [p for n in parts if storage.exists(self.spark, p := f"{self.folder}/part={n}")]
        elif not storage.exists(self.spark, f"{self.folder}/_SUCCESS"):
            paths = []
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).option("basePath", self.folder).parquet(*paths)

    def state(self) -> DataFrame:
        """The latest state of all cases, as :func:`redline.operators.checkpoint.latest_state`."""
        return self._read().drop("place", "part")

    # --- changes --------------------------------------------------------------

    def rebuild(self, state: DataFrame) -> None:
        """Start from the latest state of the log; both folders are replaced whole."""
        self.folder = new_folder(self.spark, "state")
        placed = self._placed(state).withColumn("part", self._part())
        placed.repartition("part").write.partitionBy("part").parquet(self.folder)
        known = self._read().where("part >= 0")
        csv.write_ranges(_predicted(known), self.predictions, "part", "place", _PREDICTIONS)
        csv.write_ranges(_failed(known), self.failures, "part", "place", K.FAILURE_COLUMNS)

    def update(self, records: DataFrame, *, placed: bool = True) -> list[int]:
        """Take records later than all before; returns the ranges that were written.

        ``placed`` says that ``row_index`` of the records is the row of their case.
        """
        records = records.withColumn("place", F.col("row_index")) if placed else self._placed(records)
        records = keep(records)
        # no more ranges than the batch has cases
        parts = sorted(r.part for r in records.select(self._part().alias("part")).distinct().collect())
        if not parts:
            return parts
        new = keep(C.merged(self._read(parts).drop("part"), records).withColumn("part", self._part()))
        new.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(self.folder)
        own = [n for n in parts if n >= 0]
        known = new.where("part >= 0")
        csv.replace_ranges(_predicted(known), self.predictions, own, "part", "place", _PREDICTIONS)
        csv.replace_ranges(_failed(known), self.failures, own, "part", "place", K.FAILURE_COLUMNS)
        return parts


def _predicted(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") == K.SUCCESS).select("part", "place", *_PREDICTIONS)


def _failed(state: DataFrame) -> DataFrame:
    own = [c for c in K.FAILURE_COLUMNS if c not in ("part", "place")]
    return C.failed(state).select("part", "place", *own)
