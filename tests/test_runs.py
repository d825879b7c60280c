"""Files, logs and resumable runs, scenario by scenario."""

import json

import pytest
from pyspark.sql import functions as F

from redline import cli
from redline import constants as K
from redline.operators import checkpoint as C
from redline.operators import errors as R
from redline.operators import generators as G
from redline.operators import prompts as P
from redline.plans.runner import Paths, Runner
from redline.plans.settings import Settings, load
from redline.sources import artifacts, csv, jsonl
from redline.streaming.incremental import process_stream

FAST = Settings(request_delay_seconds=0.0)


def case(i, template=None, dictation="normal"):
    template = template or f"FINDINGS:\nBONES: Normal.\n\nIMPRESSION:\nNormal study {i}."
    return (i - 1, f"case_{i:04d}", "XRAY", "Knee", "XR", "40-44", "female", template, dictation)


def cases(spark, n=5):
    schema = "row_index bigint, " + ", ".join(f"{c} string" for c in K.CASE_COLUMNS)
    return spark.createDataFrame([case(i) for i in range(1, n + 1)], schema)


def runner(spark, tmp_path, n=5, generator=None, **paths):
    p = Paths(str(tmp_path / "ck"), str(tmp_path / "out"), **{k: str(tmp_path / v) for k, v in paths.items()})
    return Runner(spark, cases(spark, n), generator or G.MockGenerator(), FAST, p)


def ids(df):
    return sorted(r["case_id"] for r in df.select("case_id").collect())


def test_resume_scenarios(spark, tmp_path):
    first = runner(spark, tmp_path, generator=G.MockGenerator(["case_0003"]), calls="calls", details="details")
    s = first.run(resume=False, limit=3)
    assert (s.succeeded, s.failed, s.call_count) == (2, 1, 5)
    state = {r.case_id: r for r in first.state().collect()}
    assert [state[f"case_000{i}"].status for i in (1, 2, 3)] == ["SUCCESS", "SUCCESS", "FAILED"]
    assert state["case_0003"].attempts == 3 and state["case_0003"].error_category == "MOCK"
    failures = csv.read_strings(spark, first.paths.output("failures.csv"))
    assert failures.columns[1:] == list(K.FAILURE_COLUMNS) and ids(failures) == ["case_0003"]
    with pytest.raises(R.SubmissionError, match="case_0003"):
        first.export()

    again = runner(spark, tmp_path, calls="calls", details="details")
    s = again.run(resume=True, limit=2)
    assert (s.succeeded, s.failed, s.call_count) == (2, 0, 2)
    assert again.log().count() == 5 and again.counts()["succeeded"] == 4
    assert ids(csv.read_strings(spark, again.paths.output("failures.csv"))) == []
    calls = spark.read.json(str(tmp_path / "calls")).groupBy("case_id").count().collect()
    assert {r.case_id: r["count"] for r in calls} == {
        "case_0001": 1, "case_0002": 1, "case_0003": 4, "case_0004": 1,
    }
    assert ids(again.remaining()) == ["case_0005"]
    again.run(resume=True)
    assert again.finalize() == 5
    submission = csv.read_strings(spark, again.paths.output("submission.csv")).orderBy("row_index").collect()
    assert [r.case_id for r in submission] == [f"case_000{i}" for i in range(1, 6)]
    marker = spark.read.text(again.paths.output("test_predictions.complete")).collect()
    assert [r.value for r in marker[:2]] == ["status: COMPLETE", "cases: 5"]
    details = spark.read.json(str(tmp_path / "details")).where("status = 'SUCCESS'").first()
    assert details.edited_sections == ["BONES"] and details.impression_changed
    assert len(again.wipe()) == 5 and again.counts()["attempted"] == 0


def test_model_generator_retries_by_category(spark, tmp_path):
    good = json.dumps({"findings_edits": {"BONES": "Seen 3 mm."}, "impression": None})

    def make_client():
        def call(system, turns):
            text = turns[-1][1]
            if "study 1." in text:
                return good
            if "study 2." in text:
                return "not json"
            if "study 3." in text:
                error = type("ClientError", (Exception,), {"code": 401})("denied")
                raise error
            if "study 4." in text:
                return json.dumps({"findings_edits": {"LUNGS": "x"}})
            raise TimeoutError("late")

        return call

    made = G.ModelGenerator(make_client, lambda d: P.build(d, "sys"), "m1")
    r = runner(spark, tmp_path, generator=made)
    s = r.run(resume=False)
    got = {x.case_id[-1]: (x.status, x.attempts, x.error_category) for x in r.state().collect()}
    assert got == {
        "1": ("SUCCESS", 1, None), "2": ("FAILED", 3, "INVALID_OUTPUT"), "3": ("FAILED", 1, "AUTH"),
        "4": ("FAILED", 3, "INVALID_OUTPUT"), "5": ("FAILED", 3, "TIMEOUT"),
    }
    assert s.call_count == 11


def test_tolerant_log(spark, tmp_path):
    folder = tmp_path / "log"
    folder.mkdir()
    rec = lambda **x: json.dumps(dict(case_id="a", row_index=0, status="SUCCESS", report="r") | x)
    lines = [
        rec(), "", rec(case_id="b", status="FAILED"), "{broken", rec(status="FAILED", attempts="2"),
        rec(case_id=" "), rec(status="PENDING"), rec(row_index=None), rec(case_id="b") + " x",
        rec(case_id="b")[:-7],
    ]
    (folder / "log.jsonl").write_text("\n".join(lines))
    d = jsonl.read_tolerant(spark, str(folder / "log.jsonl"))
    assert sorted(r.line_no for r in d.where("corrupt").collect()) == [4, 9, 10]
    log = C.valid_records(C.typed_records(d.where("NOT corrupt")))
    state = {r.case_id: (r.status, r.attempts) for r in C.latest_state(log, "line_no").collect()}
    assert state == {"a": ("FAILED", 2), "b": ("FAILED", 1)}
    assert jsonl.read_tolerant(spark, str(tmp_path / "none")).count() == 0


def test_line_numbers_over_splits(spark, tmp_path):
    path = tmp_path / "many.jsonl"
    path.write_text("".join(json.dumps({"n": i, "pad": "x" * (i % 97)}) + "\n" for i in range(1, 3001)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        d = jsonl.read_tolerant(spark, str(path))
        wrong = d.where(F.get_json_object("value", "$.n").cast("bigint") != F.col("line_no"))
        assert d.count() == 3000 and wrong.count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def write_csv(path, rows, columns):
    import csv as std

    with open(path, "w", encoding="utf-8", newline="") as handle:
        out = std.writer(handle)
        out.writerow(columns)
        out.writerows(rows)


def test_csv_round_trip_and_contract(spark, tmp_path):
    rows = [list(case(i, dictation=d)[1:]) for i, d in ((1, 'say "x",\nok'), (2, " kept "), (3, "007"))]
    rows[1][1] = " CT "
    path = tmp_path / "test.csv"
    write_csv(path, rows, K.CASE_COLUMNS)
    d = csv.read_cases(spark, str(path), expected=3).orderBy("row_index").collect()
    assert [r.dictation for r in d] == ['say "x",\nok', " kept ", "007"] and d[1].modality == "CT"
    out = str(tmp_path / "copy")
    csv.write(csv.read_cases(spark, str(path), expected=3), out)
    assert [r.template_content for r in csv.read_strings(spark, out).orderBy("row_index").collect()] == [r.template_content for r in d]
    rows[2][0], rows[0][7] = rows[1][0], " "
    write_csv(path, rows, K.CASE_COLUMNS)
    with pytest.raises(R.DataValidationError, match="duplicate.*expected 132.*dictation"):
        csv.read_cases(spark, str(path))
    with pytest.raises(R.DataValidationError):
        csv.read_cases(spark, str(tmp_path / "none.csv"))


def test_settings_and_errors():
    s = load({"MAX_RETRIES": "0", "REQUEST_DELAY_SECONDS": "x", "MODEL_TEMPERATURE": "0.5"})
    assert (s.max_retries, s.request_delay_seconds, s.temperature, s.max_output_tokens) == (3, 2.0, 0.5, 8192)
    with pytest.raises(RuntimeError):
        s.require_api_key()
    api = type("APIError", (Exception,), {})
    denied = api()
    denied.code = 403
    known = [
        (R.MockFailure(), "MOCK"), (R.InvalidModelOutput(), "INVALID_OUTPUT"), (TimeoutError(), "TIMEOUT"),
        (ConnectionResetError(), "TRANSIENT"), (OSError(), "TRANSIENT"), (R.TemplateError(), "GENERIC"),
        (denied, "AUTH"), (api(), "GENERIC"),
    ]
    assert [R.classify_exception(e) for e, _ in known] == [c for _, c in known]


def test_command_line(spark, tmp_path, monkeypatch):
    monkeypatch.setenv("REQUEST_DELAY_SECONDS", "0")
    path = tmp_path / "test.csv"
    write_csv(path, [case(i)[1:] for i in range(1, 4)], K.CASE_COLUMNS)
    base = ["run", "--test-csv", str(path), "--expected-rows", "3", "--checkpoints-dir", str(tmp_path / "ck"),
            "--outputs-dir", str(tmp_path / "out")]
    assert cli.main(base) == 1  # no key
    assert cli.main(base + ["--mock", "--limit", "1"]) == 0
    with pytest.raises(SystemExit) as stop:
        cli.main(base + ["--mock"])
    assert stop.value.code == 2
    assert cli.main(base + ["--export-submission"]) == 1
    assert cli.main(base + ["--mock", "--resume"]) == 0
    assert (tmp_path / "out" / "test_predictions.complete").exists()
    assert cli.main(base + ["--export-submission"]) == 0

    report = "FINDINGS:\nBONES: Broken.\n\nIMPRESSION:\nNormal."
    labelled = [[*case(i, dictation="fracture seen")[1:], report] for i in range(1, 9)]
    train = tmp_path / "train.csv"
    write_csv(train, labelled, [*K.CASE_COLUMNS, "report"])
    model = str(tmp_path / "model.json")
    assert cli.main(["train", "--train-csv", str(train), "--out", model]) == 0
    data = json.loads(open(model).read())
    assert data == {"by_modality_bodypart": {"XRAY / Knee": {"BONES": 1.0}}, "by_term": {"fracture": {"BONES": 1.0}}}
    assert artifacts.load_model(spark, model).count() == 2
    assert artifacts.load_model(spark, str(tmp_path / "no.json")).count() == 0
    assert cli.main(["analyze", "--csv", str(train), "--out-dir", str(tmp_path / "stats")]) == 0
    assert json.loads((tmp_path / "stats" / "training_edit_analysis.json").read_text())["findings_edited"] == 8
    assert cli.main(["inspect", "--test-csv", str(path), "--train-csv", str(train), "--expected-rows", "3",
                     "--model", model, "--inspect", "1"]) == 0


def test_stream(spark, tmp_path):
    r = runner(spark, tmp_path, n=4)
    folder = str(tmp_path / "in")
    cases(spark, 2).write.mode("append").parquet(folder)
    query = process_stream(r, folder)
    assert query.awaitTermination(120)
    cases(spark, 4).where("row_index >= 1").write.mode("append").parquet(folder)
    assert process_stream(r, folder).awaitTermination(120)
    assert r.counts() == {"attempted": 4, "succeeded": 4, "failed": 0} and r.log().count() == 4
