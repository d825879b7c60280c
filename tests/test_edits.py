"""Parsing, editing, analysis and validation on small texts with known results."""

import json

import pytest
from pyspark.sql import functions as F

from redline.functions import modeltext as M
from redline.operators import analysis as A
from redline.operators import edits as E
from redline.operators import prompts as P
from redline.operators import retrieval as S
from redline.operators import routing as W
from redline.operators import template as T
from redline.operators import validation as V
from redline.plans import corpus
from redline.plans.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"
I = "\nIMPRESSION:\n"
SECTIONED = "FINDINGS:\nBONES: Normal. No fracture.\nJOINTS: Fine.\nSOFT PARTS:\nMild swelling.\nOTHER FINDINGS:\nNone.\n" + I + "No acute change."
GROUPED = "FINDINGS:\nGroup: \nFirst part: ok.\n\nSecond part: ok.\n" + I + "Fine."
PROSE = "FINDINGS:\nLine one.\nLine two.\n" + I + "Fine."
CASE = "case_id string, template_content string, body_part string, dictation string, report string"


def frame(spark, rows):
    return spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], CASE).coalesce(2)


def apply(spark, items):
    """items: (template, edits, impression, body part, dictation) -> (report, warnings, error)."""
    rows = [(str(i), t, b, d, (e, imp)) for i, (t, e, imp, b, d) in enumerate(items)]
    schema = (
        "case_id string, template_content string, body_part string, dictation string, "
        "edits struct<findings_edits:map<string,string>,impression:string>"
    )
    d = E.apply_edits(spark.createDataFrame(rows, schema).coalesce(2))
    return [(r.report, r.apply_warnings, r.apply_error) for r in d.orderBy(F.col("case_id").cast("int")).collect()]


def sections(spark, text):
    d = T.explode_sections(frame(spark, [(text, "", "", "")]), "template_content", ["case_id"])
    return [(r.label, r.body, r.start_line, r.end_line) for r in d.orderBy("position").collect()]


def test_sections(spark):
    assert sections(spark, SECTIONED) == [
        ("BONES", "Normal. No fracture.", 1, 2), ("JOINTS", "Fine.", 2, 3),
        ("SOFT PARTS", "Mild swelling.", 3, 5), ("OTHER FINDINGS", "None.", 5, 7),
    ]
    assert sections(spark, GROUPED) == [
        ("Group", "", 1, 2), ("First part", "ok.", 2, 3), ("Second part", "ok.", 4, 5),
    ]
    assert sections(spark, PROSE) == []
    # One-letter labels are no headers; a header may stand right after FINDINGS:.
    assert sections(spark, "FINDINGS:AB: x\nJ: ok\n\n\nIMPRESSION: y") == [("AB", "x\nJ: ok", 0, 2)]


def test_structure_errors(spark):
    texts = ["x", "FINDINGS:\na", "FINDINGS:\nIMPRESSION:\nIMPRESSION:", SECTIONED, ""]
    d = T.parse(frame(spark, [(t, "", "", "") for t in texts]), "template_content", "t")
    errors = [r.t_error for r in d.orderBy("case_id").collect()]
    assert [e is None for e in errors] == [False, False, False, True, False]


def test_apply_keeps_untouched_text(spark):
    got = apply(spark, [
        (SECTIONED, {}, None, "Knee", ""),
        (SECTIONED, {"JOINTS": "New."}, None, "Knee", ""),
        (SECTIONED, {"BONES": "a\nb", "JOINTS": ""}, "Changed.\n", "Knee", ""),
        (GROUPED, {"First part": "bad."}, None, "Knee", ""),
        (PROSE, {"FINDINGS": "One.\nTwo.\n"}, None, "Neck", ""),
    ])
    assert [g[1:] for g in got] == [([], None)] * 5
    assert got[0][0] == SECTIONED
    assert got[1][0] == SECTIONED.replace("JOINTS: Fine.", "JOINTS: New.")
    assert got[2][0] == SECTIONED.replace("BONES: Normal. No fracture.\nJOINTS: Fine.", "BONES:\na\nb\nJOINTS:").replace("No acute change.", "Changed.")
    assert got[3][0] == GROUPED.replace("First part: ok.", "First part: bad.")
    assert got[4][0] == PROSE.replace("Line one.\nLine two.", "One.\nTwo.")


def test_apply_duplicate_labels_edit_both(spark):
    (report, _, error), = apply(spark, [("FINDINGS:\nAA: x\nAA: y\n" + I + "z", {"AA": "n"}, None, "", "")])
    assert error is None and report == "FINDINGS:\nAA: n\nAA: n\n" + I + "z"


def test_apply_rejections(spark):
    got = apply(spark, [
        (SECTIONED, {"LUNGS": "x", "AIR": "y"}, None, "", ""),
        (PROSE, {"BONES": "x"}, None, "", ""),
        (PROSE, {}, "New.", "", ""),
        (PROSE, {"FINDINGS": " \n"}, None, "", ""),
        (SECTIONED, {}, " \n", "", ""),
        ("no structure", {}, None, "", ""),
    ])
    assert all(report is None and error for report, _, error in got)
    assert "['AIR', 'LUNGS']" in got[0][2] and got[5][2].startswith("TemplateError")


def test_placeholders(spark):
    t = "FINDINGS:\nBONES: The [left/right] bone, size[ and shape].\n" + I + "Normal [generic] spine, [_laterality_]."
    got = apply(spark, [
        (t, {}, None, "Lumbar spine", "left LEFT right"),
        (t, {}, None, "", "nothing said"),
        (t, {}, None, "Knee", "bilateral left"),
    ])
    assert "The left bone, size and shape." in got[0][0] and got[0][0].endswith("Normal lumbar spine, left.")
    assert got[0][1] == []
    assert "[" not in got[1][0] and len(got[1][1]) == 2 and all("left unresolved" in w for w in got[1][1])
    assert got[2][0].endswith("Normal knee spine, bilateral.")


def test_derive_round_trip(spark):
    report = SECTIONED.replace("Fine.", "Effusion.").replace("Mild swelling.", "mild   SWELLING.").replace("No acute change.", "Effusion.")
    renamed = SECTIONED.replace("JOINTS:", "JOINT SPACE:").replace("No acute change.", "")
    d = E.with_derived_edits(frame(spark, [(SECTIONED, "", "", report), (SECTIONED, "", "", renamed), ("x", "", "", report)]))
    got = [r.edits for r in d.orderBy("case_id").collect()]
    assert got[0].findings_edits == {"JOINTS": "Effusion."} and got[0].impression == "Effusion."
    assert got[1].findings_edits == {} and got[1].impression is None
    assert got[2] is None
    (again, _, error), = apply(spark, [(SECTIONED, got[0].findings_edits, got[0].impression, "", "")])
    assert error is None and " ".join(again.lower().split()) == " ".join(report.lower().split())


def test_classify(spark):
    rows = [
        (SECTIONED, "", "", SECTIONED.replace("Fine.", "Fine. More.")),
        (SECTIONED, "", "", SECTIONED.replace("JOINTS:", "JOINT SPACE:")),
        (SECTIONED, "", "", SECTIONED.replace("JOINTS: Fine.\n", "")),
        (SECTIONED, "", "", SECTIONED),
        ("bad", "", "", SECTIONED),
    ]
    d = frame(spark, rows).withColumn("modality", F.lit("CT"))
    a = {r.case_id: r for r in A.analyze(d).collect()}
    assert a["0"].edited == ["JOINTS"] and a["0"].added == [] and a["0"].added_chars == 6
    assert a["1"].edited == [] and a["1"].added == ["JOINT SPACE"] and a["1"].unchanged[1] == "JOINTS"
    assert a["2"].edited == ["JOINTS"]
    assert a["3"].preserved_exactly and a["3"].char_edit_ratio == 0 and not a["3"].findings_changed
    assert a["4"].sectioned and a["4"].template_section_count == 0 and not a["4"].parsed


def test_last_body_wins_and_first_in_summary(spark):
    report = "FINDINGS:\nAA: one\nBB: two\nAA: three\n" + I + "z"
    template = "FINDINGS:\nAA: three\nBB: two\n" + I + "z"
    d = frame(spark, [(template, "", "", report)]).withColumn("modality", F.lit("CT"))
    assert A.analyze(d, char_edits=False).first().edited == []
    assert A.edit_summary(d).first().edited_sections == ["AA"]


def test_corpus_stats_and_median(spark):
    d = frame(spark, [(SECTIONED, "", "", SECTIONED.replace("Fine.", "Bad.")), (SECTIONED, "", "", SECTIONED)])
    a = A.analyze(d.withColumn("modality", F.lit("CT")))
    s = A.corpus_stats(a).first()
    assert (s.total_cases, s.findings_edited, s.average_edited_sections, s.median_edited_sections) == (2, 1, 0.5, 0.5)
    assert s.percent_mostly_unchanged == 100.0
    for values in ([], [0.3], [0.1, 0.2], [0.0] * 30 + [1.0] * 30, [0.5, 0.25, 0.75, 0.250001, 1.0]):
        v = spark.createDataFrame([(x,) for x in values], "v double").coalesce(1)
        want = None
        if values:
            o = sorted(values)
            want = (o[(len(o) - 1) // 2] + o[len(o) // 2]) / 2
        assert A.exact_median(v, "v", bins=8).first()["median"] == want


def test_validation(spark):
    ok = "FINDINGS:\nBONES: Normal.\nOTHER FINDINGS:\nnote\n" + I + "Fine."
    rows = [
        ("", "", "", ok), ("", "", "", " "), ("", "", "", "text"), ("", "", "", ok.replace("Fine.", "")),
        ("", "", "", ok.replace("note", "[generic] note")), ("", "", "", ok.replace("note", "lone ]")),
        ("", "", "size 121.3 mL", ok), ("", "", "", ok.replace("OTHER FINDINGS", "BONES")),
        ("", "", "", "FINDINGS:\n\n" + I + "Fine."),
    ]
    d = V.validate_reports(frame(spark, rows)).orderBy("case_id")
    got = [(r.errors, r.warnings) for r in d.collect()]
    assert got[0] == ([], [])
    assert got[1] == (["report is empty"], [])
    assert [len(g[0]) for g in got] == [0, 1, 1, 1, 1, 1, 0, 0, 1]
    assert "'[generic]'" in got[4][0][0] and "placeholder" in got[4][1][0]
    assert "121.3 mL" in got[6][1][0] and "['BONES']" in got[7][1][0]


@pytest.mark.parametrize("raw, edits, impression", [
    ('{"findings_edits": {" A ": " x "}, "impression": " y "}', {"A": "x"}, "y"),
    ('{"findings_edits": {}}', {}, None),
    ('```json\n{"findings_edits": {}, "impression": null}\n```', {}, None),
    ('{"findings_edits": {"A": "x", "A": "z"}}', {"A": "z"}, None),
])
def test_decode_valid(spark, raw, edits, impression):
    got = spark.createDataFrame([(raw,)], "t string").select(M.decode_edits(F.col("t")).alias("d")).first().d
    assert (got.findings_edits, got.impression, got.error) == (edits, impression, None)


def test_decode_invalid(spark):
    bad = [
        None, "", "no json", "[]", '{"findings_edits": {}, "x": 1}', "{}", '{"findings_edits": []}',
        '{"findings_edits": {"A": 5}}', '{"findings_edits": {" ": "x"}}', '{"findings_edits": {}, "impression": 5}',
        '{"findings_edits": {"A": "x\\n IMPRESSION: \\ny"}}', '{"findings_edits": {}, "impression": "FINDINGS:"}',
        '{"findings_edits": {}} trailing', "```\n```",
    ]
    d = spark.createDataFrame([(i, t) for i, t in enumerate(bad)], "i int, t string").coalesce(1)
    rows = d.select(M.decode_edits(F.col("t")).alias("d")).collect()
    assert all(r.d.error and r.d.findings_edits is None for r in rows)


def test_edits_as_json_equals_python(spark):
    outputs = [
        {"findings_edits": {}, "impression": None},
        {"findings_edits": {"A/B": 'quote " back \\ tab\t nl\n é \U0001f600 /'}, "impression": "x\ny"},
        {"findings_edits": {"A": "", "B": "b"}, "impression": ""},
    ]
    schema = "e struct<findings_edits:map<string,string>,impression:string>"
    d = spark.createDataFrame([((o["findings_edits"], o["impression"]),) for o in outputs], schema).coalesce(1)
    got = [r.j for r in d.select(M.edits_as_json(F.col("e")).alias("j")).collect()]
    assert got == [json.dumps(o, ensure_ascii=False, indent=2) for o in outputs]


def test_prompts(spark):
    cases = frame(spark, [(SECTIONED, "Knee", "pain", ""), (PROSE, "Neck", "none", ""), ("bad", "", "", "")])
    hints = spark.createDataFrame([("0", ["JOINTS"]), ("1", ["JOINTS"])], "case_id string, candidates array<string>")
    shot = {"template": PROSE, "dictation": "d", "output": {"findings_edits": {"FINDINGS": "x"}, "impression": None}}
    built = {r.case_id: r for r in P.build(cases, "sys", examples=[shot] * 5, candidates=hints).collect()}
    assert sorted(built) == ["0", "1"]
    turns = built["0"].turns
    assert [t.role for t in turns] == ["user", "model"] * 3 + ["user"]
    assert json.loads(turns[1].text) == shot["output"]
    assert turns[-1].text.endswith("a HINT only, not a restriction):\n- JOINTS") and "- OTHER FINDINGS\n" in turns[-1].text
    assert "HINT" not in built["1"].turns[-1].text and "- FINDINGS\n" in built["1"].turns[-1].text
    labelled = frame(spark, [(SECTIONED, "Knee", "a", SECTIONED.replace("Fine.", "Bad."))])
    top = spark.createDataFrame([("0", 2, "0"), ("1", 1, "0")], "case_id string, rank int, match_id string")
    dynamic = P.build(cases, "sys", retrieved=P.retrieved_examples(top, labelled))
    by_id = {r.case_id: r.turns for r in dynamic.collect()}
    assert by_id["0"][0].text.startswith("REAL TRAINING EXAMPLE 2\n\n") and '"JOINTS": "Bad."' in by_id["0"][1].text


def test_texts_are_derived_once(spark):
    """A condition on derived edits must not compute the texts again at the source."""
    for name in ("apply_edits", "parse_model_json", "mock_edits"):
        plan = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(text") == 1, name


def test_answers_are_written_once(spark):
    """Each damaged form of an answer, and each step of reading it, wrote the JSON anew."""
    plan = QUERIES["parse_model_json"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("StructsToJsonEvaluator") <= 5


def test_log_lines_are_written_and_read_once(spark):
    """Neither the damage nor the filters on typed records may write or read a line a second time."""
    plan = QUERIES["checkpoint_records"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert [plan.count(f) for f in ("StructsToJsonEvaluator", "from_json(", "jsonObjectKeys")] == [1, 1, 1]


def test_sections_that_differ_outside_their_bodies_are_no_edits(spark):
    same = "FINDINGS:\nÄ: x\nLUNGS: Clear é.\nHEART:  Fine.\n\nBONES: Old.\nIMPRESSION:\nÜ"
    other = same.replace("HEART:  Fine.", "HEART: fine.").replace("BONES: Old.\n", "BONES:\nNew.\n\n").replace("Ü", "ü\n")
    d = E.with_derived_edits(frame(spark, [(same, "", "", same), (same, "", "", other)]))
    rows = [r.edits for r in d.orderBy("case_id").collect()]
    assert [(r.findings_edits, r.impression) for r in rows] == [({}, None), ({"BONES": "New."}, None)]


def test_editable_keeps_rows_with_edits(spark):
    d = spark.sql("SELECT * FROM VALUES (1, 'a'), (2, null), (3, '') AS t(id, edits)")
    assert sorted((r.id, r.edits) for r in E.editable(d).collect()) == [(1, "a"), (3, "")]


def test_placeholders_made_by_a_replacement(spark):
    """Tokens are replaced in their order, also those that an earlier replacement completes."""
    text = "[left/[left/right]/bilateral] and [generic]"
    d = spark.createDataFrame([(text, "left leg bone", "right"), ("no token", "x", "left")], "r string, b string, d string")
    out = d.select(E.resolve_placeholders(F.col("r"), F.col("b"), F.col("d")).alias("o")).collect()
    assert [r.o for r in out] == ["right and left leg", "no token"]


def test_only_counts_with_support_are_weighed(spark):
    """Counts too small to qualify never reach the window; totals and groups without any label stay."""
    rows = [("a", ["X"])] * 3 + [("a", ["Y"]), ("b", ["Y"])]
    d = W._associations(spark.createDataFrame(rows, "signal string, edited array<string>"), ["signal"])
    got = sorted((r.signal, r.label or "", r.n, r.total) for r in d.collect())
    assert got == [("a", "", 4, 4), ("a", "X", 3, 4), ("b", "", 1, 1)]


def test_texts_of_prompts_and_features_are_derived_once(spark):
    cases = corpus.all_cases(spark, SMALL)
    for name, d in (("prompts", P.build(cases, "system")), ("index", S.index_features(cases))):
        plan = d._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("split(text") == 1, name


def test_names_are_the_labels_of_the_sections(spark):
    d = T.parse(frame(spark, [(t, "", "", "") for t in (SECTIONED, GROUPED, PROSE, "x")]), "template_content", "t")
    rows = d.select(T.labels(F.col("t_sections")).alias("a"), T.names(F.col("template_content")).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]
    assert [r.b for r in rows][2:] == [[], None]
