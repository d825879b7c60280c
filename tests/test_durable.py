"""Runs that stop, replacements that fail, logs with odd numbers."""

import json

import pytest
from pyspark.sql import functions as F
from test_runs import FAST, case, cases, ids, runner

from redline.operators import checkpoint as C
from redline.operators import generators as G
from redline.plans import corpus
from redline.plans.runner import Paths, Runner
from redline.plans.statistics import corpus_statistics, json_document, text_report
from redline.sources import artifacts, shared, storage
from redline.streaming.incremental import process_stream


class Stopping(G.MockGenerator):
    """Stops the driver when it is asked for a given round the n-th time."""

    def __init__(self, failing, attempt, times=1):
        super().__init__(failing)
        self.attempt, self.times = attempt, times

    def generate(self, pending, attempt):
        if attempt == self.attempt:
            self.times -= 1
            if not self.times:
                raise KeyboardInterrupt
        return super().generate(pending, attempt)


def calls(spark, tmp_path):
    rows = spark.read.json(str(tmp_path / "calls")).groupBy("case_id").count().collect()
    return {r.case_id[-1]: r["count"] for r in rows}


def test_stop_in_round_two_keeps_what_was_settled(spark, tmp_path):
    first = runner(spark, tmp_path, generator=Stopping(["case_0003"], attempt=2), calls="calls")
    with pytest.raises(KeyboardInterrupt):
        first.run(resume=False)
    assert calls(spark, tmp_path)["1"] == 1
    again = runner(spark, tmp_path, calls="calls")
    assert ids(again.remaining()) == ["case_0003"] and again.log().count() == 4
    s = again.run(resume=True)
    assert (s.succeeded, s.failed) == (1, 0)
    seen = calls(spark, tmp_path)
    assert all(seen[i] == 1 for i in "1245") and seen["3"] >= 2
    assert again.finalize() == 5


def test_stop_in_a_later_batch(spark, tmp_path):
    paths = Paths(str(tmp_path / "ck"), str(tmp_path / "out"))
    first = Runner(spark, cases(spark, 6), Stopping([], attempt=1, times=3), FAST, paths, batch_size=2)
    with pytest.raises(KeyboardInterrupt):
        first.run(resume=False)
    done = first.counts()["succeeded"]
    assert 2 <= done < 6
    assert storage.exists(spark, paths.output("test_predictions.csv"))
    again = Runner(spark, cases(spark, 6), G.MockGenerator(), FAST, paths, batch_size=2)
    assert again.run(resume=True).succeeded == 6 - done and again.finalize() == 6
    merged = again.state().select("case_id", "status", "attempts").collect()
    assert sorted(merged) == sorted(C.latest_state(again.log()).select("case_id", "status", "attempts").collect())


def test_batches_cover_all_cases_once(spark, tmp_path):
    r = runner(spark, tmp_path, n=23)
    r.batch_size = 5
    parts = [ids(b) for b in r.batches(corpus.keep(r.cases))]
    assert sorted(sum(parts, [])) == ids(r.cases) and len(parts) > 2
    assert list(r.batches(r.cases.limit(0))) == []


def test_latency_counts_all_attempts(spark, tmp_path):
    class Slow(G.MockGenerator):
        def generate(self, pending, attempt):
            return super().generate(pending, attempt).withColumn("latency", F.lit(1.5))

    r = runner(spark, tmp_path, n=2, generator=Slow(["case_0002"]))
    r.run(resume=False)
    assert {x.case_id[-1]: x.latency_seconds for x in r.state().collect()} == {"1": 1.5, "2": 4.5}


def test_failed_replacement_keeps_the_old_file(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "f.txt")
    storage.write_text(spark, path, "old")
    real = storage._fs

    class Failing:
        def __init__(self, fs):
            self.fs = fs

        def rename(self, a, b):
            return False if ".new-" in str(a.toString()) else self.fs.rename(a, b)

        def __getattr__(self, name):
            return getattr(self.fs, name)

    monkeypatch.setattr(storage, "_fs", lambda s, p: (Failing(real(s, p)[0]), real(s, p)[1]))
    with pytest.raises(OSError):
        storage.write_text(spark, path, "new")
    monkeypatch.undo()
    assert storage.read_text(spark, path, "file") == "old"
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["f.txt"]

    def broken():
        yield "half"
        raise RuntimeError

    with pytest.raises(RuntimeError):
        storage.write_text(spark, path, broken())
    assert storage.read_text(spark, path, "file") == "old"
    (tmp_path / "f.txt").rename(tmp_path / "f.txt.old")  # as a stop between the two moves leaves it
    with pytest.raises(RuntimeError):
        storage.write_text(spark, path, broken())
    assert storage.read_text(spark, path, "file") == "old"


def test_wipe_lets_a_stream_start_anew(spark, tmp_path):
    r = runner(spark, tmp_path, n=2)
    folder = str(tmp_path / "in")
    r.cases.write.parquet(folder)
    assert process_stream(r, folder).awaitTermination(120)
    assert r.counts()["succeeded"] == 2
    r.wipe()
    assert r.counts()["attempted"] == 0
    assert process_stream(r, folder).awaitTermination(120)
    assert r.counts()["succeeded"] == 2


def test_numbers_that_do_not_fit_drop_their_line(spark):
    def rec(**x):
        return json.dumps(dict(case_id="a", row_index=0, status="SUCCESS", report="r") | x)

    lines = [
        rec(row_index=3_000_000_000), rec(case_id="b", row_index="Infinity"), rec(case_id="c", attempts=1e30),
        rec(case_id="d", row_index=10**40), rec(case_id="e", row_index="7.0"), rec(case_id="f", row_index="x"),
    ]
    d = C.typed_records(spark.createDataFrame([(x,) for x in lines], "value string"))
    assert sorted((r.case_id, r.row_index) for r in d.collect()) == [("a", 3_000_000_000), ("e", 7)]


def test_documents_of_any_size(spark, tmp_path):
    rows = [("group", f"G {i:05d}", f"L{j}", 0.5) for i in range(3000) for j in range(2)] + [("term", "alone", None, None)]
    model = spark.createDataFrame(rows, "kind string, signal string, label string, weight double")
    path = str(tmp_path / "model.json")
    artifacts.export_model(model, path)
    data = json.loads(open(path).read())
    assert len(data["by_modality_bodypart"]) == 3000 and data["by_term"] == {"alone": {}}
    assert open(path).read() == json.dumps(data, indent=2, sort_keys=True) + "\n"
    assert sorted(map(repr, artifacts.load_model(spark, path).collect())) == sorted(map(repr, model.collect()))
    artifacts.export_model(model.limit(0), path)
    assert json.loads(open(path).read()) == {"by_modality_bodypart": {}, "by_term": {}}


def test_statistics_list_every_group(spark):
    from redline.operators import analysis as A

    report = "FINDINGS:\nBONES: Broken.\n\nIMPRESSION:\nNormal."
    rows = [(*case(i)[:3], f"Part {i}", *case(i)[4:], report) for i in range(1, 6)]
    df = spark.createDataFrame(rows, cases(spark).schema.add("report", "string"))
    stats, groups = corpus_statistics(A.analyze(df))
    data = json.loads("".join(json_document(stats, groups)))
    assert data["total_cases"] == 5 and len(data["by_group"]) == 5
    assert data["by_group"]["XRAY / Part 1"] == {"findings_edited": 1, "total": 1}
    assert "XRAY / Part 5" in "".join(text_report(stats, groups))


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": lambda self, key, default: default})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_folder(Session())
