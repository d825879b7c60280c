"""Where edits come from: a deterministic mock, or a caller's model function."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline import constants as K
from redline.functions import modeltext as M
from redline.functions import text as X
from redline.operators import template as P
from redline.operators.errors import classify_exception


# Texts of the mock.
MOCK_SECTION = "Mockized review for "
MOCK_IMPRESSION = ("Mock impression (", ") - not clinically meaningful.")


class Generator:
    """Adds ``edits``, ``error_category`` and ``error_message`` to a batch of cases."""

    model_name = "unknown"

    def generate(self, cases: DataFrame, attempt: int) -> DataFrame:
        raise NotImplementedError


class MockGenerator(Generator):
    """Edits every section with a snippet of the dictation; pure column expressions."""

    model_name = "mock"

    def __init__(self, fail_case_ids: Iterable[str] = ()):
        self.fail_case_ids = tuple(fail_case_ids)

    def generate(self, cases: DataFrame, attempt: int) -> DataFrame:
        d = P.parse(cases, "template_content", "g").withColumn(
            "_labels", F.array_distinct(P.labels(F.col("g_sections")))
        )
        words = X.snippet(F.col("dictation"))
        sectioned = X.bind(
            words,
            lambda s: F.map_from_entries(
                F.transform(
                    "_labels",
                    lambda n: F.struct(n, F.concat(F.lit(MOCK_SECTION), n, F.lit(": "), s)),
                )
            ),
        )
        edits = F.struct(
            F.when(F.size("_labels") > 0, sectioned)
            .otherwise(F.create_map(F.lit(K.WHOLE_BLOCK), words)).alias("findings_edits"),
            F.concat(
                F.lit(MOCK_IMPRESSION[0]), "case_id", F.lit(MOCK_IMPRESSION[1])
            ).alias("impression"),
        )
        failing = F.col("case_id").isin(*self.fail_case_ids) if self.fail_case_ids else F.lit(False)
        error = F.when(
            failing,
            F.concat(
                F.lit("MockFailure: injected for case "), "case_id", F.lit(f" (attempt {attempt})")
            ),
        ).otherwise(F.col("g_error"))
        category = F.when(failing, "MOCK").when(F.col("g_error").isNotNull(), "GENERIC")
        return (
            d.withColumn("edits", F.when(error.isNull(), edits))
            .withColumn("error_message", error)
            .withColumn("error_category", category)
            .drop("_labels", *[f"g_{n}" for n in ("error", "region", "after", "chunks", "sections")])
        )


class ModelGenerator(Generator):
    """Calls ``make_client()(system, turns) -> text`` for every prompt.

    ``build_prompts`` turns cases into (case_id, system, turns).  A client is
    made once per task; exceptions become columns.  Only the call itself runs
    in Python: prompts, edits and checks stay column expressions.

    ``delay_seconds`` is the least time between two calls of the whole job: the
    prompts are dealt to ``lanes`` tasks (by default as many as can run at once),
    and each lane leaves ``lanes`` times the delay between the begins of its calls.
    Lanes that wait for a free core or have nothing left make the job slower, never
    faster.
    """

    def __init__(
        self,
        make_client: Callable[[], Callable[[str, list[tuple[str, str]]], str]],
        build_prompts: Callable[[DataFrame], DataFrame],
        model_name: str = "model",
        delay_seconds: float = 0.0,
        lanes: int | None = None,
    ):
        self.make_client, self.build_prompts, self.model_name = make_client, build_prompts, model_name
        self.delay_seconds, self.lanes = delay_seconds, lanes

    def generate(self, cases: DataFrame, attempt: int) -> DataFrame:
        make_client, delay = self.make_client, self.delay_seconds
        prompts = self.build_prompts(cases).select("case_id", "system", "turns")
        lanes = self.lanes or cases.sparkSession.sparkContext.defaultParallelism
        if delay:
            prompts = prompts.repartition(lanes)

        def call(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            client = make_client()
            # the first calls of the lanes are as far apart as all others
            free = time.monotonic() + (delay * (TaskContext.get().partitionId() % lanes) if delay else 0)
            for batch in batches:
                out = []
                for case_id, system, turns in batch.itertuples(index=False):
                    answer = category = note = None
                    time.sleep(max(0.0, free - time.monotonic()))
                    begun = time.monotonic()
                    free = begun + delay * lanes
                    try:
                        answer = client(system, [(t["role"], t["text"]) for t in turns])
                    except Exception as exc:  # becomes the record of this attempt
                        category, note = classify_exception(exc), f"{type(exc).__name__}: {exc}"
                    out.append((case_id, answer, category, note, time.monotonic() - begun))
                yield pd.DataFrame(out, columns=["case_id", "_answer", "_category", "_note", "latency"])

        answers = prompts.mapInPandas(
            call, "case_id string, _answer string, _category string, _note string, latency double"
        )
        decoded = answers.withColumn("_edits", M.decode_edits(F.col("_answer")))
        failed = F.col("_category").isNotNull()
        error = F.when(failed, F.col("_note")).otherwise(F.col("_edits.error"))
        found = decoded.select(
            "case_id", "latency",
            F.when(error.isNull(), F.struct("_edits.findings_edits", "_edits.impression")).alias("edits"),
            error.alias("error_message"),
            F.when(failed, F.col("_category"))
            .when(error.isNotNull(), F.lit("INVALID_OUTPUT")).alias("error_category"),
        )
        # A case without a prompt has a template that cannot be parsed.
        d = cases.join(found, "case_id", "left")
        lost = F.col("latency").isNull()
        return d.withColumns(
            {
                "error_category": F.when(lost, "GENERIC").otherwise(F.col("error_category")),
                "error_message": F.when(lost, P.structure_error(F.col("template_content"))).otherwise(
                    F.col("error_message")
                ),
                "latency": F.coalesce("latency", F.lit(0.0)),
            }
        )
