"""CSV tables of strings: cases, labelled cases, submissions."""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import constants as K
from redline.functions import text as X
from redline.operators.errors import DataValidationError
from redline.operators.validation import check_dataset
from redline.sources import numbering, storage
from redline.sources.records import records

_FORMAT = {"header": True, "quote": '"', "escape": '"', "encoding": "UTF-8"}
_WRITE = {**_FORMAT, "emptyValue": "", "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def read_strings(spark: SparkSession, path: str) -> DataFrame:
    """All columns as text, in file order (``row_index``); empty cells are empty text.

    Files are read in ranges by many tasks.  Line breaks inside quoted cells are
    kept, with CRLF read as LF.
    """
    names = spark.read.options(**_FORMAT, multiLine=True, inferSchema=False, maxCharsPerColumn=-1).csv(str(path)).columns
    found = records(spark, path) if names else None
    if found is None:
        return read_whole(spark, path)
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    options = {k: v for k, v in _FORMAT.items() if k != "header"} | {"maxCharsPerColumn": "-1"}
    record = F.replace(F.col("record"), F.lit("\r\n"), F.lit("\n"))
    record = F.when(record.endswith("\r"), F.left(record, F.length(record) - 1)).otherwise(record)  # the break of the record itself
    d = found.select("row_index", F.from_csv(record, schema, options).alias("x"))
    return d.select("row_index", *[X.text(F.col(f"x.c{i}")).alias(c) for i, c in enumerate(names)])


def read_whole(spark: SparkSession, path: str) -> DataFrame:
    """The same with one task for each file."""
    scan = spark.read.options(
        **_FORMAT, multiLine=True, inferSchema=False, maxCharsPerColumn=-1
    ).csv(str(path))
    names = scan.columns
    d = numbering.with_position(scan, "row_index", per_file=False)
    return d.select("row_index", *[X.text(F.col(f"`{c}`")).alias(c) for c in names])


def require(df: DataFrame, columns: Iterable[str], what: str, error: type = ValueError) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise error(f"{what} lacks columns {missing}")
    return df


def _clean(df: DataFrame) -> DataFrame:
    """Trim ids and metadata; templates, dictations and reports stay as they are."""
    verbatim = ("row_index", "template_content", "dictation", "report")
    return df.select(*[c if c in verbatim else X.strip(F.col(c)).alias(c) for c in df.columns])


def read_cases(spark: SparkSession, path: str, expected: int | None = K.EXPECTED_CASES) -> DataFrame:
    """Cases to process, checked against the data contract before trimming."""
    if not storage.exists(spark, path):
        raise DataValidationError(f"no case data at {path}")
    df = read_strings(spark, path)
    check_dataset(df, expected)
    return _clean(df.select("row_index", *K.CASE_COLUMNS))


def read_labelled(spark: SparkSession, path: str, columns: Iterable[str] = K.CASE_COLUMNS) -> DataFrame:
    """Labelled cases; only the columns a job needs have to exist."""
    if not storage.exists(spark, path):
        raise FileNotFoundError(f"no labelled cases at {path}")
    df = require(read_strings(spark, path), (*columns, "report"), "labelled cases")
    return _clean(df)


def read_submission(spark: SparkSession, path: str) -> DataFrame:
    if not storage.exists(spark, path):
        raise DataValidationError(f"no submission skeleton at {path}")
    return require(read_strings(spark, path), ("case_id", "report"), "submission", DataValidationError)


def write(df: DataFrame, path: str, order: str = "row_index", keep: Iterable[str] | None = None) -> None:
    """Replace a CSV folder; its part files are in row order, so none is one task's work."""
    columns = list(keep or df.columns)
    ordered = df.orderBy(order).select(*columns)
    storage.replace(df.sparkSession, path, lambda fresh: ordered.write.options(**_WRITE).csv(fresh))


def write_ranges(df: DataFrame, path: str, part: str, order: str, keep: Iterable[str]) -> None:
    """Replace a CSV folder by one that has files of their own for each value of ``part``, a whole number from 0.

    Names of files are in the order of ``part``, and each is sorted by ``order``.
    """
    columns = list(keep)

    def fill(fresh: str) -> None:
        storage.write_text(df.sparkSession, f"{fresh}/header.csv", ",".join(columns))
        _move_ranges(df, fresh, None, part, order, columns)

    storage.replace(df.sparkSession, path, fill)


def replace_ranges(df: DataFrame, path: str, parts: list[int], part: str, order: str, keep: Iterable[str]) -> None:
    """Put the files of ``df`` in the place of those of ``parts``; the other files of the folder are not touched.

    A part without rows loses its files.  A reader can meet the moment in which
    a part is between its two versions, and a stop then leaves it out until the
    next ``write_ranges``.
    """
    _move_ranges(df, path, parts, part, order, list(keep))


def _move_ranges(df: DataFrame, folder: str, parts: list[int] | None, part: str, order: str, columns: list[str]) -> None:
    spark = df.sparkSession
    beside = f"{folder}.part-{uuid.uuid4().hex}"
    rows = df.repartition(part).sortWithinPartitions(part, order).select(part, *columns)
    try:
        rows.write.options(**_WRITE).partitionBy(part).csv(beside)
        fresh = {
            int(name.rsplit("=", 1)[1]): storage.names(spark, f"{beside}/{name}", ".csv")
            for name in storage.names(spark, beside) if name.startswith(f"{part}=")
        }
        old: dict[int, list[str]] = {}
        for name in storage.names(spark, folder, ".csv") if parts else []:
            if name.startswith("rows-"):
                old.setdefault(int(name.split("-")[1]), []).append(name)
        for n in sorted(fresh) if parts is None else parts:
            for name in old.get(n, []):
                storage.remove(spark, f"{folder}/{name}")
            for i, name in enumerate(fresh.get(n, [])):
                storage.move(spark, f"{beside}/{part}={n}/{name}", f"{folder}/rows-{n:012d}-{i:03d}.csv")
    finally:
        storage.remove(spark, beside)
