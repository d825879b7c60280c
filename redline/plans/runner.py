"""A resumable run: generate, apply, check, log, and publish the outcome.

Cases are taken in batches of ``batch_size`` by row, and attempts of a batch are
rounds: one Spark job over its cases still open.  What a round settles, by
success or by its last failure, is appended to the log before the next round
starts, and predictions and failures follow each batch, in the ranges of rows
that it touches (``plans/views.py``).  A run that stops loses the round it was in and the attempts of cases it would have tried
again, nothing that was settled.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline import constants as K
from redline.operators import analysis as A
from redline.operators import checkpoint as C
from redline.operators import edits as E
from redline.operators import errors as R
from redline.operators import validation as V
from redline.operators.generators import Generator
from redline.plans import corpus
from redline.plans.settings import Settings
from redline.plans.views import Views
from redline.sources import csv, jsonl, storage

_CASE = ["row_index", *K.CASE_COLUMNS]
_BATCH = 1 << 40  # records of one run share the upper part of seq
_LOG = C.RECORD.fieldNames() + ["seq"]


def _now() -> str:
    return datetime.now(timezone.utc).replace(microsecond=0).isoformat()


@dataclass(frozen=True)
class Paths:
    checkpoints: str
    outputs: str
    details: str | None = None
    calls: str | None = None

    @property
    def log(self) -> str:
        return f"{self.checkpoints}/checkpoints.jsonl"

    def output(self, name: str) -> str:
        return f"{self.outputs}/{name}"

    @property
    def artifacts(self) -> list[str]:
        names = ("test_predictions.csv", "failures.csv", "submission.csv", "test_predictions.complete")
        return [self.log, *[self.output(n) for n in names], self.stream]

    @property
    def stream(self) -> str:
        """What a stream remembers of the files it has read."""
        return f"{self.checkpoints}/stream"


@dataclass(frozen=True)
class Summary:
    succeeded: int
    failed: int
    call_count: int
    started_at: str
    finished_at: str


class Runner:
    def __init__(self, spark: SparkSession, cases: DataFrame, generator: Generator,
                 settings: Settings, paths: Paths, batch_size: int = 10_000):
        self.spark, self.cases, self.generator = spark, cases, generator
        self.settings, self.paths, self.batch_size = settings, paths, batch_size
        self._next: int | None = None  # upper part of the next seq
        self.views = Views(
            spark, cases, paths.output("test_predictions.csv"), paths.output("failures.csv"), batch_size
        )

    # --- log ------------------------------------------------------------------

    def log(self) -> DataFrame:
        """Valid records with their order; unreadable lines are skipped."""
        lines = jsonl.read_tolerant(self.spark, self.paths.log).where(~F.col("corrupt"))
        # Records of a foreign log carry no order: their line numbers come first.
        seq = F.coalesce(F.get_json_object("value", "$.seq").try_cast("bigint"), F.col("line_no") - _BATCH)
        return C.valid_records(C.typed_records(lines.select(seq.alias("seq"), "value")))

    def corrupt_lines(self) -> DataFrame:
        lines = jsonl.read_tolerant(self.spark, self.paths.log)
        return lines.where("corrupt").select("file", "line_no")

    def state(self) -> DataFrame:
        return C.latest_state(self.log())

    def counts(self) -> dict:
        return C.state_counts(self.state()).first().asDict()

    def wipe(self) -> list[str]:
        """Remove what earlier runs wrote, so that a stream starts anew too."""
        self._next = None
        return [p for p in self.paths.artifacts if storage.remove(self.spark, p)]

    # --- work -----------------------------------------------------------------

    def _attempt(self, pending: DataFrame, attempt: int) -> DataFrame:
        """One round: every pending case with its report or its error."""
        if self.paths.calls:
            calls = pending.select("case_id", F.lit(attempt).alias("attempt"))
            jsonl.append(calls, self.paths.calls)
        made = self.generator.generate(pending, attempt)
        if "latency" not in made.columns:
            made = made.withColumn("latency", F.lit(0.0))
        made = made.withColumns({"_category": F.col("error_category"), "_message": F.col("error_message")})
        d = V.validate_reports(E.apply_edits(made.drop("error_category", "error_message")))
        rejected = F.when(
            F.size("errors") > 0,
            F.concat(F.lit("InvalidModelOutput: report rejected: "), F.array_join("errors", "; ")),
        )
        fault = F.coalesce("apply_error", rejected)
        message = F.coalesce("_message", fault)
        category = F.when(F.col("_message").isNotNull(), F.col("_category")).when(
            fault.isNotNull(),
            F.when(F.startswith(fault, F.lit("InvalidModelOutput")), "INVALID_OUTPUT").otherwise("GENERIC"),
        )
        good = message.isNull()
        return corpus.keep(
            d.select(
                *_CASE,
                good.alias("_good"),
                F.when(good, "SUCCESS").otherwise("FAILED").alias("status"),
                F.when(good, F.col("report")).otherwise("").alias("report"),
                F.lit(attempt).alias("attempts"),
                F.round(F.col("spent") + F.col("latency"), 3).alias("latency_seconds"),
                category.alias("error_category"),
                F.left(message, F.lit(2000)).alias("error_message"),
                F.lit(self.generator.model_name).alias("model"),
                F.lit(_now()).alias("timestamp"),
                F.when(good, F.concat("apply_warnings", "warnings"))
                .otherwise(F.array().cast("array<string>")).alias("notes"),
            )
        )

    def process(self, cases: DataFrame) -> DataFrame:
        """Outcome of every case after at most ``max_retries`` rounds; each round is logged as it ends.

        Latency counts all attempts of a case.
        """
        settled, pending = [], cases.select(*_CASE, F.lit(0.0).alias("spent"))
        for attempt in range(1, self.settings.max_retries + 1):
            outcome = self._attempt(pending, attempt)
            again = ~F.col("_good") & R.is_retryable(F.coalesce("error_category", F.lit("GENERIC")))
            if attempt == self.settings.max_retries:
                again = F.lit(False)
            done = outcome.where(~again)
            self.record(done)
            settled.append(done)
            pending = outcome.where(again).select(*_CASE, F.col("latency_seconds").alias("spent"))
            if attempt == self.settings.max_retries or pending.isEmpty():
                break
            time.sleep(self.settings.backoff(attempt))
        return reduce(DataFrame.unionAll, settled)

    def record(self, outcome: DataFrame) -> None:
        """Append the outcome to the log, and to the details log if there is one."""
        if self._next is None:  # one writer at a time: the log is read once
            last = self.log().agg(F.max("seq")).first()[0]
            self._next = 0 if last is None or last < 0 else last // _BATCH + 1
        rows = outcome.withColumn("warnings", F.array_join("notes", "\n")).withColumn(
            "seq", F.lit(self._next * _BATCH) + F.col("row_index")
        )
        jsonl.append(rows.select(*_LOG), self.paths.log)
        self._next += 1
        if self.paths.details:
            d = A.edit_summary(outcome)
            jsonl.append(
                d.select(
                    "case_id", "status", "attempts", "latency_seconds", "model",
                    F.col("notes").alias("warnings"),
                    F.coalesce("error_message", F.lit("")).alias("errors"), "report",
                    "edited_sections", "edited_section_count", "impression_changed", "char_edit_ratio",
                ),
                self.paths.details,
            )

    def batches(self, todo: DataFrame) -> Iterator[DataFrame]:
        """Parts of about ``batch_size`` cases in row order; the borders are quantiles."""
        n = -(-todo.count() // self.batch_size)
        if n <= 1:
            if n:
                yield todo
            return
        shares = [i / n for i in range(1, n)]
        borders = sorted(set(todo.approxQuantile("row_index", shares, 0.1 / n)))
        row = F.col("row_index")
        for low, high in zip([None, *borders], [*borders, None]):
            yield todo.where(F.lit(True) if low is None else row >= low).where(F.lit(True) if high is None else row < high)

    def run(self, *, resume: bool, limit: int | None = None) -> Summary:
        started = _now()
        state = corpus.keep(self.state())
        self.publish(state)
        todo = corpus.keep(C.plan(self.cases, state, resume=resume, limit=limit))
        totals = [0, 0, 0]
        for batch in self.batches(todo):
            outcome = self.process(batch)
            counted = outcome.agg(
                F.count_if("_good"), F.count_if(~F.col("_good")), F.coalesce(F.sum("attempts"), F.lit(0))
            ).first()
            totals = [a + b for a, b in zip(totals, counted)]
            self.views.update(self.as_records(outcome))
        return Summary(*totals, started, _now())

    def as_records(self, outcome: DataFrame) -> DataFrame:
        """An outcome that is logged already, as records later than all before."""
        return outcome.withColumn("warnings", F.array_join("notes", "\n")).withColumn(
            "seq", F.lit((self._next or 0) * _BATCH) + F.col("row_index")
        ).select(*_LOG)

    # --- results --------------------------------------------------------------

    def publish(self, state: DataFrame | None = None) -> None:
        """Rebuild predictions and failures from the latest state, by default that of the log."""
        self.views.rebuild(corpus.keep(self.state()) if state is None else state)

    def remaining(self) -> DataFrame:
        return C.remaining(self.cases, self.state())

    def submission_errors(self, state: DataFrame | None = None) -> list[str]:
        """At most eleven messages; none means the run is final."""
        state = self.state() if state is None else state
        rows = V.submission_errors(self.cases, state).orderBy("rank").collect()
        return [r["message"] for r in rows]

    def export(self) -> int:
        """Write the submission, all or nothing; returns its number of rows."""
        state = corpus.keep(self.state())
        faults = self.submission_errors(state)
        if faults:
            raise R.SubmissionError("submission rejected:\n" + "\n".join(faults))
        done = C.predictions(self.cases, state)
        csv.write(done, self.paths.output("submission.csv"), keep=("case_id", "report"))
        return done.count()

    def finalize(self) -> int:
        """Export and mark the run as complete."""
        n = self.export()
        storage.write_text(
            self.spark, self.paths.output("test_predictions.complete"),
            f"status: COMPLETE\ncases: {n}\ntimestamp: {_now()}\n",
        )
        return n
