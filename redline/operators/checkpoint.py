"""The log of case outcomes: typed records, latest state and what is left to do."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline import constants as K
from redline.functions import text as X
from redline.operators.template import once

RECORD = T.StructType(
    [
        T.StructField("case_id", T.StringType()),
        T.StructField("row_index", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("report", T.StringType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("latency_seconds", T.DoubleType()),
        T.StructField("error_category", T.StringType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("timestamp", T.StringType()),
        T.StructField("warnings", T.StringType()),
    ]
)
_NUMBERS = {"row_index": ("bigint", -1), "attempts": ("int", 1), "latency_seconds": ("double", 0.0)}


def typed_records(lines: DataFrame, value: str = "value") -> DataFrame:
    """Records from JSON text: absent fields get defaults, unusable numbers drop the line."""
    raw = T.StructType([T.StructField(f.name, T.StringType()) for f in RECORD.fields])
    read = F.struct(F.from_json(value, raw).alias("r"), F.json_object_keys(value).alias("k"))
    d = once(lines.withColumn("_read", read), "_read")
    keys = F.col("_read.k")
    good = keys.isNotNull()
    columns = []
    for field in RECORD.fields:
        text = F.col(f"_read.r.{field.name}")
        if field.name in _NUMBERS:
            kind, default = _NUMBERS[field.name]
            # A number may come as text, and an integer as a decimal number.
            number = F.coalesce(text.try_cast(kind), text.try_cast("double").try_cast(kind))
            absent = ~F.array_contains(keys, field.name)
            good = good & (absent | number.isNotNull())
            text = F.when(absent, F.lit(default).cast(kind)).otherwise(number)
        elif not field.name.startswith("error_"):
            text = X.text(text)
        columns.append(text.alias(field.name))
    other = [c for c in lines.columns if c not in RECORD.fieldNames()]
    d = d.where(good).select(*other, *columns)
    return d.withColumn("case_id", X.strip(F.col("case_id")))


def valid_records(log: DataFrame) -> DataFrame:
    return log.where((X.strip(X.text(F.col("case_id"))) != "") & F.col("status").isin(K.SUCCESS, K.FAILED))


def latest_state(log: DataFrame, order: str = "seq") -> DataFrame:
    """Last valid record of each case in log order.

    An aggregate and not a window: records of a case are reduced before the
    shuffle, so a case with very many attempts does not load one task.
    """
    fields = [c for c in log.columns if c not in ("case_id", order)]
    last = valid_records(log).groupBy("case_id").agg(
        F.max_by(F.struct(*fields), order).alias("_last"),
        F.max(order).alias(order),
        F.min(order).alias("first_seq"),
    )
    return last.select("case_id", order, "first_seq", "_last.*")


def merged(state: DataFrame, records: DataFrame, order: str = "seq") -> DataFrame:
    """The latest state after further records: as ``latest_state`` of both, without the log."""
    known = state.select(*records.columns, "first_seq")
    both = known.unionByName(records.withColumn("first_seq", F.col(order)))
    fields = [c for c in records.columns if c not in ("case_id", order)]
    last = valid_records(both).groupBy("case_id").agg(
        F.max_by(F.struct(*fields), order).alias("_last"), F.max(order).alias(order), F.min("first_seq").alias("first_seq")
    )
    return last.select("case_id", order, "first_seq", "_last.*")


def state_counts(state: DataFrame) -> DataFrame:
    return state.agg(
        F.count("*").alias("attempted"),
        F.count_if(F.col("status") == K.SUCCESS).alias("succeeded"),
        F.count_if(F.col("status") == K.FAILED).alias("failed"),
    )


def _succeeded(state: DataFrame) -> DataFrame:
    return state.where(F.col("status") == K.SUCCESS).select("case_id")


def remaining(cases: DataFrame, state: DataFrame) -> DataFrame:
    """Cases without a success."""
    return cases.join(_succeeded(state), "case_id", "left_anti")


def plan(cases: DataFrame, state: DataFrame, *, resume: bool, limit: int | None = None) -> DataFrame:
    """Cases to process, in source order; the limit counts after skipping."""
    todo = remaining(cases, state) if resume else cases
    return todo if limit is None else todo.orderBy("row_index").limit(max(0, int(limit)))


def predictions(cases: DataFrame, state: DataFrame) -> DataFrame:
    done = state.where(F.col("status") == K.SUCCESS).select("case_id", "report")
    return cases.select("case_id", "row_index").join(done, "case_id")


def failed(state: DataFrame) -> DataFrame:
    """Cases whose last record is a failure; missing error texts are empty."""
    return state.where(F.col("status") == K.FAILED).withColumns(
        {c: X.text(F.col(c)) for c in ("error_category", "error_message")}
    )


def failures(cases: DataFrame, state: DataFrame) -> DataFrame:
    return failed(state).select(*K.FAILURE_COLUMNS).join(cases.select("case_id"), "case_id", "left_semi")
