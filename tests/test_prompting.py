"""Prompts from files: retrieved examples, static fallback, command line."""

import json

import pytest
from test_runs import case, write_csv

from redline import cli
from redline import constants as K
from redline.operators.errors import DataValidationError
from redline.plans import prompting
from redline.sources import csv

EXAMPLES = {"examples": [{
    "name": "one", "template": "FINDINGS:\nBONES: Normal.\n\nIMPRESSION:\nNormal.", "dictation": "broken",
    "output": {"findings_edits": {"BONES": "Broken."}, "impression": None},
}]}


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    d = tmp_path_factory.mktemp("prompts")
    (d / "system.txt").write_text("  Edit the template.\n")
    (d / "examples.json").write_text(json.dumps(EXAMPLES))
    write_csv(d / "test.csv", [case(i)[1:] for i in (1, 2)], K.CASE_COLUMNS)
    report = "FINDINGS:\nBONES: Broken.\n\nIMPRESSION:\nNormal."
    labelled = [[*case(i, dictation=f"fracture seen {i}")[1:], report] for i in range(11, 16)]
    labelled.append([*case(16, template="no headers")[1:], report])
    write_csv(d / "train.csv", labelled, [*K.CASE_COLUMNS, "report"])
    return d


def load(spark, files, **paths):
    return prompting.load(spark, str(files / "system.txt"), **{k: str(files / v) for k, v in paths.items()})


def turns(builder, spark, files):
    cases = csv.read_cases(spark, str(files / "test.csv"), 2)
    rows = builder(cases).collect()
    assert {r.system for r in rows} == {"Edit the template."}
    return {r.case_id: [(t.role, t.text) for t in r.turns] for r in rows}


def test_retrieved_examples(spark, files):
    builder = load(spark, files, train_path="train.csv", examples_path="examples.json")
    assert prompting.skipped_rows(builder.labelled) == 1
    for made in turns(builder, spark, files).values():
        assert [role for role, _ in made] == ["user", "model"] * 3 + ["user"]
        assert [t.split("\n")[0] for _, t in made[0:6:2]] == [f"REAL TRAINING EXAMPLE {i}" for i in (1, 2, 3)]
        assert json.loads(made[1][1])["findings_edits"] == {"BONES": "Broken."}


def test_static_examples_stand_in(spark, files):
    for paths in ({"train_path": "none.csv"}, {}, {"train_path": "test.csv"}):  # missing, none, without reports
        builder = load(spark, files, examples_path="examples.json", **paths)
        for made in turns(builder, spark, files).values():
            assert [role for role, _ in made] == ["user", "model", "user"] and "broken" in made[0][1]
            assert not made[0][1].startswith("REAL")


def test_nothing_usable_leaves_the_case_alone(spark, files):
    write_csv(files / "bad.csv", [[*case(1, template="x")[1:], "y"]], [*K.CASE_COLUMNS, "report"])
    builder = load(spark, files, train_path="bad.csv", examples_path="none.json", model_path="none.json")
    assert all(len(made) == 1 for made in turns(builder, spark, files).values())


def test_faulty_files_are_errors(spark, files):
    (files / "blank.txt").write_text(" \n")
    with pytest.raises(ValueError):
        prompting.load(spark, str(files / "blank.txt"))
    with pytest.raises(FileNotFoundError):
        prompting.load(spark, str(files / "missing.txt"))
    (files / "faulty.json").write_text('{"examples": [{"template": "x"}]}')
    with pytest.raises(ValueError):
        load(spark, files, examples_path="faulty.json")


def test_submission_skeleton(spark, files):
    write_csv(files / "skeleton.csv", [["a", "x"]], ["case_id", "report"])
    assert [r.case_id for r in csv.read_submission(spark, str(files / "skeleton.csv")).collect()] == ["a"]
    with pytest.raises(DataValidationError):
        csv.read_submission(spark, str(files / "test.csv"))
    with pytest.raises(DataValidationError):
        csv.read_submission(spark, str(files / "none.csv"))


def test_prompts_and_client_from_the_command_line(spark, files, tmp_path, monkeypatch):
    flags = ["--test-csv", str(files / "test.csv"), "--expected-rows", "2", "--train-csv", str(files / "train.csv"),
             "--system-prompt", str(files / "system.txt"), "--model", str(files / "none.json")]
    assert cli.main(["prompts", *flags, "--out", str(tmp_path / "prompts")]) == 0
    assert spark.read.parquet(str(tmp_path / "prompts")).count() == 2
    monkeypatch.setenv("REQUEST_DELAY_SECONDS", "0")
    monkeypatch.setenv("MODEL_API_KEY", "x")

    def make_client():
        def call(system, turns):
            assert system == "Edit the template." and len(turns) == 7
            return json.dumps({"findings_edits": {"BONES": "Seen."}, "impression": None})

        return call

    run = ["run", *flags, "--checkpoints-dir", str(tmp_path / "ck"), "--outputs-dir", str(tmp_path / "out")]
    assert cli.main(run, make_client=make_client) == 0
    assert (tmp_path / "out" / "test_predictions.complete").exists()
