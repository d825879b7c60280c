"""Predictions and failures that follow batches range by range."""

import random

import pytest
from test_runs import case, cases, ids, runner

from redline import constants as K
from redline.operators import checkpoint as C
from redline.operators import generators as G
from redline.plans.views import Views
from redline.sources import csv
from redline.streaming.incremental import process_stream

LOG = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in C.RECORD.fields) + ", seq long"


def record(case_id, row, seq, ok=True, **other):
    error = (None, None) if ok else ("MOCK", 'no, "quoted"\nline')
    made = (case_id, row, "SUCCESS" if ok else "FAILED", f'r "{seq}",\n of {case_id}' if ok else "", 1, 0.5, *error, "m", f"t{seq}", "", seq)
    return made


def views(spark, tmp_path, n, rows):
    return Views(spark, cases(spark, n), str(tmp_path / "p.csv"), str(tmp_path / "f.csv"), rows)


def content(spark, v):
    p = csv.read_strings(spark, v.predictions).orderBy("row_index").collect()
    f = csv.read_strings(spark, v.failures).orderBy("row_index").drop("row_index").collect()
    return [(r.case_id, r.report) for r in p], [tuple(r) for r in f]


def files(path):
    return {x.name: x.stat().st_mtime_ns for x in path.iterdir() if x.name.endswith(".csv")}


def test_batches_equal_one_state_of_the_log(spark, tmp_path):
    r, log = random.Random(5), []
    v = views(spark, tmp_path, 23, 4)
    v.rebuild(C.latest_state(spark.createDataFrame([], LOG)))
    assert content(spark, v) == ([], []) and csv.read_strings(spark, v.failures).columns[1:] == list(K.FAILURE_COLUMNS)
    for step in range(4):
        rows = [record(f"case_{i + 1:04d}", i, 1000 * step + i, r.random() < 0.6) for i in r.sample(range(23), 9)]
        if step == 2:
            rows.append(record("stranger", 5, 1000 * step + 99))
        log += rows
        v.update(spark.createDataFrame(rows, LOG), placed=step != 2)
    state = C.latest_state(spark.createDataFrame(log, LOG))
    columns = state.columns
    assert sorted(map(repr, v.state().select(columns).collect())) == sorted(map(repr, state.collect()))
    whole = views(spark, tmp_path / "whole", 23, 4)
    whole.rebuild(state)
    assert content(spark, v) == content(spark, whole)
    known, failed = content(spark, v)
    want = C.predictions(v.cases, state).orderBy("row_index").select("case_id", "report").collect()
    assert known == [tuple(x) for x in want] and len(failed) == C.failures(v.cases, state).count() > 0
    assert "stranger" not in dict(known)


def test_only_touched_ranges_are_written(spark, tmp_path):
    v = views(spark, tmp_path, 40, 5)
    rows = [record(f"case_{i + 1:04d}", i, i) for i in range(40)]
    v.rebuild(C.latest_state(spark.createDataFrame(rows, LOG)))
    before = files(tmp_path / "p.csv")
    assert len(before) == 9
    assert v.update(spark.createDataFrame([record("case_0012", 11, 100, ok=False), record("case_0014", 13, 101)], LOG)) == [2]
    after = files(tmp_path / "p.csv")
    assert {n for n in after if after[n] != before.get(n)} == {"rows-000000000002-000.csv"}
    known, failed = content(spark, v)
    assert len(known) == 39 and [f[0] for f in failed] == ["case_0012"] and dict(known)["case_0014"].startswith('r "101"')
    # a range that loses its last failure loses its file
    v.update(spark.createDataFrame([record("case_0012", 11, 200)], LOG))
    assert content(spark, v)[1] == [] and set(files(tmp_path / "f.csv")) == {"header.csv"}
    assert not [x for x in tmp_path.iterdir() if ".part-" in x.name or ".new-" in x.name]
    assert v.update(spark.createDataFrame([], LOG)) == []


def test_state_before_a_rebuild_is_an_error(spark, tmp_path):
    v = views(spark, tmp_path, 2, 5)
    with pytest.raises(ValueError):
        v.state()


def test_stream_with_rows_of_its_own(spark, tmp_path):
    r = runner(spark, tmp_path, n=4, generator=G.MockGenerator(["case_0002"]))
    folder = str(tmp_path / "in")
    schema = r.cases.schema
    own = [(i + 70, *case(n)[1:]) for i, n in enumerate((3, 2, 9))]  # other row numbers; one case that the run does not know
    spark.createDataFrame(own, schema).coalesce(1).write.parquet(folder)
    assert process_stream(r, folder).awaitTermination(120)
    predictions = csv.read_strings(spark, r.paths.output("test_predictions.csv"))
    assert ids(predictions) == ["case_0003"]
    assert ids(csv.read_strings(spark, r.paths.output("failures.csv"))) == ["case_0002"]
    assert r.counts() == {"attempted": 3, "succeeded": 2, "failed": 1}
