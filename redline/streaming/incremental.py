"""Cases that arrive as files, processed batch by batch with the same log.

The stream's own checkpoint remembers which files were read; the latest state
decides what has succeeded, so a batch that is replayed after a failure only
repeats cases without a success.  The state is read from the log once; then each
batch changes the ranges of its own cases, in the state, predictions and failures.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from redline.operators import checkpoint as C
from redline.plans import corpus
from redline.plans.runner import Runner

CASE_SCHEMA = (
    "row_index bigint, case_id string, modality string, body_part string, study_description string, "
    "patient_age_band string, patient_sex string, template_content string, dictation string"
)


def process_stream(runner: Runner, path: str, files_per_batch: int = 100) -> StreamingQuery:
    """Start a query over a folder of case files (Parquet) and process what is there."""
    spark = runner.spark
    cases = (
        spark.readStream.schema(CASE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )
    runner.publish()

    def step(batch: DataFrame, _: int) -> None:
        todo = corpus.keep(C.plan(batch, runner.views.state(), resume=True))
        for part in runner.batches(todo):
            # rows of the files may be numbered in another way than the cases
            runner.views.update(runner.as_records(runner.process(part)), placed=False)

    return (
        cases.writeStream.foreachBatch(step)
        .option("checkpointLocation", runner.paths.stream)
        .trigger(availableNow=True)
        .start()
    )
