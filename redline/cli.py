"""Command line: run cases, train routing, analyse edits, inspect retrieval."""

from __future__ import annotations

import argparse
import logging
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from redline import constants as K
from redline.operators import analysis as A
from redline.operators import errors as R
from redline.operators import generators as G
from redline.operators import retrieval as S
from redline.operators import routing as W
from redline.plans import corpus, prompting
from redline.plans import settings as settings_module
from redline.plans.runner import Paths, Runner
from redline.plans.statistics import corpus_statistics, json_document, text_report
from redline.sources import artifacts, csv, storage
from redline.sources.shared import shared_folder

LOG = logging.getLogger("redline")
_TIERS = ("exact template", "near template", "moderate", "unrelated")


def _prompt_flags(job: argparse.ArgumentParser) -> None:
    job.add_argument("--system-prompt", default="prompts/system_prompt.txt")
    job.add_argument("--examples", default="prompts/few_shot_examples.json", help="used where no labelled case can be")
    job.add_argument("--train-csv", default="data/train.csv", help="labelled cases to retrieve examples from")
    job.add_argument("--model", default="prompts/routing_model.json", help="routing model for hints")
    job.add_argument("--max-examples", type=int, default=K.DEFAULT_K)


def prompt_builder(spark: SparkSession, args) -> prompting.PromptBuilder:
    builder = prompting.load(
        spark, args.system_prompt, train_path=args.train_csv, model_path=args.model,
        examples_path=args.examples, max_examples=args.max_examples,
    )
    if builder.labelled is not None:
        LOG.info("%d labelled row(s) cannot serve as examples", prompting.skipped_rows(builder.labelled))
    return builder


def build_parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="redline")
    parser.add_argument("--shared-dir", help="folder that all executors share, for intermediate tables")
    jobs = parser.add_subparsers(dest="job", required=True)

    run = jobs.add_parser("run", help="process cases, resumably")
    run.add_argument("--mode", choices=["test"], default="test")
    run.add_argument("--test-csv", default="data/test.csv")
    run.add_argument("--expected-rows", type=int, default=K.EXPECTED_CASES)
    run.add_argument("--limit", type=int, metavar="N")
    run.add_argument("--resume", action="store_true", help="skip successes, retry failures")
    run.add_argument("--fresh", action="store_true", help="remove earlier progress first")
    run.add_argument("--export-submission", action="store_true", help="only check and export")
    run.add_argument("--mock", action="store_true", help="deterministic edits, no model")
    run.add_argument("--mock-fail-case", action="append", default=[], metavar="CASE_ID")
    run.add_argument("--mock-log")
    run.add_argument("--checkpoints-dir", default="checkpoints")
    run.add_argument("--outputs-dir", default="outputs")
    run.add_argument("--details-log")
    _prompt_flags(run)

    prompts = jobs.add_parser("prompts", help="write the prompts of all cases as a table")
    prompts.add_argument("--test-csv", default="data/test.csv")
    prompts.add_argument("--expected-rows", type=int, default=K.EXPECTED_CASES)
    prompts.add_argument("--out", default="outputs/prompts")
    _prompt_flags(prompts)

    train = jobs.add_parser("train", help="learn section routing from labelled cases")
    train.add_argument("--train-csv", default="data/train.csv")
    train.add_argument("--out", default="prompts/routing_model.json")

    analyze = jobs.add_parser("analyze", help="measure how reports edit their templates")
    analyze.add_argument("--csv", default="data/train.csv")
    analyze.add_argument("--out-dir", default="outputs")

    inspect = jobs.add_parser("inspect", help="show retrieved cases")
    inspect.add_argument("--test-csv", default="data/test.csv")
    inspect.add_argument("--train-csv", default="data/train.csv")
    inspect.add_argument("--expected-rows", type=int, default=K.EXPECTED_CASES)
    inspect.add_argument("--model", default="prompts/routing_model.json")
    inspect.add_argument("--case-id")
    inspect.add_argument("--inspect", metavar="N|ID,ID", help="the first N cases, or these ids")
    inspect.add_argument("--inspect-all", action="store_true", help="write a table of all cases to --out")
    inspect.add_argument("--out", default="outputs/retrieved")
    inspect.add_argument("--k", type=int, default=K.DEFAULT_K)
    return parser


def session(shared_dir: str | None = None) -> SparkSession:
    builder = SparkSession.builder.appName("redline").config("spark.sql.adaptive.enabled", "true")
    if shared_dir:
        builder = builder.config("spark.checkpoint.dir", shared_dir)
    spark = builder.getOrCreate()
    shared_folder(spark)  # a missing one is an error now, not after hours
    return spark


def run(spark: SparkSession, args, parser, make_generator=None, make_client=None) -> int:
    settings = settings_module.load()
    cases = csv.read_cases(spark, args.test_csv, args.expected_rows)
    generator = G.MockGenerator(args.mock_fail_case)
    paths = Paths(args.checkpoints_dir, args.outputs_dir, args.details_log, args.mock_log)
    runner = Runner(spark, cases, generator, settings, paths)
    if args.fresh:
        for path in runner.wipe():
            LOG.info("removed %s", path)
    if args.export_submission:
        try:
            LOG.info("submission written: %d rows", runner.export())
        except R.SubmissionError as exc:
            LOG.error("%s", exc)
            return 1
        return 0
    attempted = runner.counts()["attempted"]
    if attempted and not (args.resume or args.fresh):
        parser.error(f"{attempted} case(s) already logged: pass --resume or --fresh")
    if not args.mock:
        try:
            settings.require_api_key()
            if make_generator is None and make_client is None:
                raise RuntimeError("no model client configured: pass make_client, make_generator or use --mock")
        except RuntimeError as exc:
            LOG.error("%s", exc)
            return 1
        runner.generator = make_generator(settings) if make_generator else G.ModelGenerator(
            make_client, prompt_builder(spark, args), settings.model or "model", settings.request_delay_seconds
        )
    try:
        LOG.info("run complete: %s", runner.run(resume=args.resume, limit=args.limit))
    except KeyboardInterrupt:
        LOG.warning("interrupted; cases settled so far are logged, go on with --resume")
        return 130
    left = [r["case_id"] for r in runner.remaining().orderBy("row_index").select("case_id").limit(3).collect()]
    if left:
        LOG.warning("incomplete, still open for example: %s", left)
        return 0
    try:
        runner.finalize()
    except R.SubmissionError as exc:
        LOG.error("%s", exc)
        return 1
    return 0


def prompts(spark: SparkSession, args) -> int:
    made = prompt_builder(spark, args)(csv.read_cases(spark, args.test_csv, args.expected_rows))
    storage.replace(spark, args.out, lambda fresh: made.write.parquet(fresh))
    return 0


def train(spark: SparkSession, args) -> int:
    cases = csv.read_labelled(
        spark, args.train_csv, ("case_id", "modality", "body_part", "template_content", "dictation")
    )
    model = W.train(corpus.keep(A.analyze(cases, char_edits=False)))
    if args.out.endswith(".json"):
        artifacts.export_model(model, args.out)
    else:
        artifacts.save_model(model, args.out)
    return 0


def analyze(spark: SparkSession, args) -> int:
    cases = csv.read_labelled(spark, args.csv, ("case_id", "template_content"))
    for name in ("modality", "body_part"):
        if name not in cases.columns:
            cases = cases.withColumn(name, F.lit(""))
    stats, groups = corpus_statistics(A.analyze(cases))
    storage.write_text(spark, f"{args.out_dir}/training_edit_analysis.json", json_document(stats, groups))
    storage.write_text(spark, f"{args.out_dir}/training_edit_analysis.txt", text_report(stats, groups))
    return 0


def inspect(spark: SparkSession, args, parser) -> int:
    cases = csv.read_cases(spark, args.test_csv, args.expected_rows)
    if args.inspect_all:
        pass
    elif args.inspect is not None:
        if args.inspect.lstrip("+-").isdigit():
            cases = cases.orderBy("row_index").limit(max(0, int(args.inspect)))
        else:
            cases = cases.where(F.col("case_id").isin([s.strip() for s in args.inspect.split(",")]))
    elif args.case_id is not None:
        cases = cases.where(F.col("case_id") == args.case_id)
    else:
        parser.error("pass --case-id, --inspect or --inspect-all")
    if cases.isEmpty():
        print("no case matches")
        return 1
    index = S.index_features(csv.read_labelled(spark, args.train_csv))
    hints = W.candidates(cases, artifacts.load_model(spark, args.model))
    top = S.retrieve(S.query_features(cases, hints), index, k=args.k, keep=corpus.keep)
    shown = top.join(cases.select("case_id", "row_index", "modality", "body_part"), "case_id")
    if args.inspect_all:
        storage.replace(spark, args.out, lambda fresh: shown.write.parquet(fresh))
        print(f"retrieved cases written to {args.out}")
        return 0
    for row in shown.orderBy("row_index", "rank").toLocalIterator():
        if row["rank"] == 1:
            print(f"\nTEST: {row['case_id']} {row['modality']} / {row['body_part']}")
        signals = ("template_similarity", "modality_bodypart", "dictation_similarity", "edited_section_relevance")
        values = " ".join(f"{name}={row[name]:.3f}" for name in signals)
        print(f"TOP {row['rank']}: {row['match_id']} score={row['score']:.3f} tier={_TIERS[row['tier']]} {values}")
    return 0


def main(argv: list[str] | None = None, make_generator=None, make_client=None) -> int:
    """``make_client()`` gives a function from (instruction, turns) to text; ``make_generator(settings)`` a generator."""
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(levelname)s %(message)s")
    parser = build_parser()
    args = parser.parse_args(argv)
    spark = session(args.shared_dir)
    if args.job == "run":
        return run(spark, args, parser, make_generator, make_client)
    if args.job == "prompts":
        return prompts(spark, args)
    if args.job == "inspect":
        return inspect(spark, args, parser)
    return train(spark, args) if args.job == "train" else analyze(spark, args)


if __name__ == "__main__":
    sys.exit(main())
