"""Every registered query: name -> function of (spark, sf_dir).

Each one reads whole tables and whole texts, so its work grows with the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions import text as X
from redline.functions import diffing
from redline.functions import modeltext as M
from redline.operators import analysis as A
from redline.operators import checkpoint as C
from redline.operators import edits as E
from redline.operators import errors as R
from redline.operators import generators as G
from redline.operators import prompts as P
from redline.operators import retrieval as S
from redline.operators import routing as W
from redline.operators import template as T
from redline.operators import validation as V
from redline.plans import corpus
from redline.plans.caseindex import CaseIndex
from redline.plans.prompting import PromptBuilder
from redline.sources.shared import new_folder

QUERIES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def _big(name: str):
    return F.col(name).cast("bigint")


def _joined(name: str):
    return F.array_join(name, "|")


# --- cases, parsing -----------------------------------------------------------


@query
def cases_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_cases(spark, sf_dir).select(
        "row_index", "case_id", "modality", "body_part", "template_content", "dictation", "report"
    )


@query
def template_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.parse(corpus.all_cases(spark, sf_dir), "template_content", "t")
    return d.select(
        "case_id",
        F.col("t_error").isNull().alias("valid"),
        T.impression_count(F.col("template_content")).cast("bigint").alias("impressions"),
        F.col("t_region").alias("region"),
        F.col("t_after").alias("after_impression"),
    )


@query
def sections_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.explode_sections(corpus.all_cases(spark, sf_dir), "template_content", ["case_id"])
    return d.select(
        "case_id", _big("position").alias("position"), "label", "body",
        _big("start_line").alias("start_line"), _big("end_line").alias("end_line"),
    )


@query
def report_sections_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.explode_sections(corpus.all_cases(spark, sf_dir), "report", ["case_id"])
    return d.select(
        "case_id", _big("position").alias("position"), "label", "body",
        _big("start_line").alias("start_line"), _big("end_line").alias("end_line"),
    )


@query
def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.parse(corpus.all_cases(spark, sf_dir), "template_content", "t")
    n = F.size("t_sections")
    return (
        d.where(T.is_valid(F.col("template_content")))
        .groupBy(A.group_key().alias("group"))
        .agg(
            F.count("*").alias("templates"),
            F.count_if(n == 0).alias("prose"),
            F.sum(n).alias("sections"),
            F.max(n).cast("bigint").alias("most_sections"),
        )
    )


@query
def section_bodies_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = T.parse(corpus.all_cases(spark, sf_dir), "report", "r")
    d = T.explode(d.select("case_id", T.last_wins(F.col("r_sections")).alias("u")), "u", "s")
    return d.select("case_id", _big("position").alias("position"), "s.label", "s.body")


# --- scalar text functions ----------------------------------------------------


@query
def normalize_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.table(spark, sf_dir, "documents").select(
        "doc_id", X.normalize(F.col("text")).alias("normalized")
    )


@query
def tokens_df(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document frequency of every token over the whole texts."""
    tokens = corpus.table(spark, sf_dir, "documents").select(
        F.explode(X.token_set(F.col("text"))).alias("token")
    )
    return tokens.groupBy("token").agg(F.count("*").alias("df"))


@query
def dictation_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.all_cases(spark, sf_dir).select(F.explode(X.terms(F.col("dictation"))).alias("term"))
    return d.groupBy("term").agg(F.count("*").alias("occurrences"))


@query
def laterality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_cases(spark, sf_dir).select(
        "case_id", X.laterality(F.col("dictation")).alias("side")
    )


@query
def generic_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_cases(spark, sf_dir).select(
        "case_id", X.generic_term(F.col("body_part")).alias("term")
    )


@query
def bracket_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = corpus.table(spark, sf_dir, "pages")
    return corpus.all_cases(spark, sf_dir).select(
        F.col("case_id").alias("id"), F.col("report").alias("t")
    ).unionAll(pages.select(F.concat(F.lit("p"), F.col("page_id").cast("string")), "html")).select(
        "id",
        F.array_join(X.bracket_spans(F.col("t")), "|").alias("spans"),
        X.drop_brackets(F.col("t")).alias("stripped"),
    )


@query
def measurement_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = corpus.all_cases(spark, sf_dir)
    return d.select(
        "case_id",
        F.size(X.measurements(F.col("dictation"))).cast("bigint").alias("measured"),
        F.array_join(X.missing_measurements(F.col("dictation"), F.col("report")), "|").alias("missing"),
    )


@query
def dictation_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.all_cases(spark, sf_dir).select(
        "case_id", X.snippet(F.col("dictation")).alias("snippet")
    )


# --- edit analytics -----------------------------------------------------------


def _analysis(spark, sf_dir, **options):
    return A.analyze(corpus.all_cases(spark, sf_dir), **options)


@query
def edit_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _analysis(spark, sf_dir, char_edits=False)
    return d.select(
        "case_id", _joined("edited").alias("edited"), _joined("unchanged").alias("unchanged"),
        _joined("added").alias("added"), "findings_changed", "impression_changed", "sectioned",
        _big("template_section_count").alias("sections"),
        _joined("template_placeholders").alias("placeholders"),
        _joined("unresolved_placeholders").alias("unresolved"),
        _big("resolved_placeholder_count").alias("resolved"),
    )


@query
def edit_rate_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.edit_rate_by_group(_analysis(spark, sf_dir, char_edits=False))


@query
def edit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.edit_histogram(_analysis(spark, sf_dir, char_edits=False))
    return d.select(_big("edited_sections").alias("edited_sections"), "cases")


@query
def top_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.top_labels(_analysis(spark, sf_dir, char_edits=False), F.col("row_index"))
    return d.select(_big("rank").alias("rank"), "label", "edits")


@query
def placeholder_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.placeholder_counts(_analysis(spark, sf_dir, char_edits=False))


@query
def corpus_edit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.corpus_stats(_analysis(spark, sf_dir, char_edits=False), char_edits=False)


@query
def char_edit_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _analysis(spark, sf_dir)
    return d.select(
        "case_id", F.round("char_edit_ratio", 9).alias("char_edit_ratio"),
        "added_chars", "deleted_chars", "preserved_exactly",
    )


@query
def char_edit_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corpus means and the exact median of the character measures, one row each."""
    d = _analysis(spark, sf_dir).select("char_edit_ratio", "added_chars", "deleted_chars")
    d = corpus.keep(d)  # both branches below read it
    means = d.agg(
        F.round(F.avg("char_edit_ratio"), 4).alias("average_ratio"),
        F.round(F.avg("added_chars"), 2).alias("average_added"),
        F.round(F.avg("deleted_chars"), 2).alias("average_deleted"),
        F.round(F.count_if(F.col("char_edit_ratio") <= 0.5) / F.count("*") * 100, 2).alias("percent_low"),
    )
    names = means.columns
    long = means.select(F.stack(F.lit(len(names)), *[x for n in names for x in (F.lit(n), n)]).alias("measure", "value"))
    median = A.exact_median(d, "char_edit_ratio").select(
        F.lit("median_ratio"), F.round("median", 9)
    )
    return long.unionAll(median)


# --- edits --------------------------------------------------------------------


def _derived(spark, sf_dir):
    return E.with_derived_edits(corpus.all_cases(spark, sf_dir))


@query
def derive_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = F.transform(
        F.map_entries("edits.findings_edits"),
        lambda e: F.struct(e["key"].alias("label"), e["value"].alias("body")),
    )
    impression = F.array(
        F.struct(F.lit("IMPRESSION").alias("label"), F.col("edits.impression").alias("body"))
    )
    d = _derived(spark, sf_dir).select("case_id", F.concat(entries, impression).alias("edits"))
    return T.explode(d, "edits", "e").select(
        "case_id", _big("position").alias("position"), "e.label", "e.body"
    )


@query
def apply_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Derived edits applied to their templates again."""
    d = _derived(spark, sf_dir).drop("report")
    d = E.apply_edits(E.editable(d), parsed=True)
    return d.select(
        "case_id", "report", F.array_join("apply_warnings", "|").alias("warnings"),
        F.col("apply_error").isNotNull().alias("rejected"),
    )


@query
def unknown_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of a report used as edit keys that its template does not have."""
    d = T.parse(T.parse(corpus.all_cases(spark, sf_dir), "template_content", "t"), "report", "r")
    d = d.where(F.col("t_error").isNull() & F.col("r_error").isNull())
    keys = T.body_map(T.last_wins(F.col("r_sections")))
    return d.select(
        "case_id", F.array_join(E.unknown_labels(keys, F.col("t_sections")), "|").alias("unknown")
    )


@query
def mock_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mock edits applied to every template, with the checks of the result."""
    d = G.MockGenerator().generate(corpus.all_cases(spark, sf_dir).drop("report"), 1)
    d = V.validate_reports(E.apply_edits(E.editable(d)))
    return d.select(
        "case_id", "report", F.array_join("apply_warnings", "|").alias("apply_warnings"),
        F.size("errors").cast("bigint").alias("n_errors"),
    )


@query
def report_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = V.validate_reports(corpus.all_cases(spark, sf_dir))
    return d.select(
        "case_id", F.array_join("errors", "|").alias("errors"), F.array_join("warnings", "|").alias("warnings")
    )


@query
def edit_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log measures of an edit: bodies compared after trimming only."""
    d = A.edit_summary(corpus.all_cases(spark, sf_dir), char_edits=False)
    return d.select(
        "case_id", _joined("edited_sections").alias("edited"), "impression_changed",
        _big("edited_section_count").alias("edited_section_count"),
    )


@query
def parse_model_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits written as JSON, damaged in several ways, fenced and decoded again."""
    d = E.editable(_derived(spark, sf_dir))
    d = T.once(d.select("case_id", "row_index", "edits", M.edits_as_json(F.col("edits")).alias("text")), "text")
    text, kind = F.col("text"), F.col("row_index") % 8
    answer = (
        F.when(kind == 1, F.concat(F.lit("```json\n"), text, F.lit("\n```")))
        .when(kind == 2, F.concat(text, F.lit(" trailing")))
        .when(kind == 3, F.replace(text, F.lit('"impression"'), F.lit('"conclusion"')))
        .when(kind == 4, F.replace(text, F.lit("null"), F.lit("5")))
        .when(kind == 5, F.replace(text, F.lit(" Measures"), F.lit("\\nIMPRESSION:\\n")))
        .when(kind == 6, F.lit("  "))
        .otherwise(text)
    )
    d = T.once(d.select("case_id", "edits", answer.alias("answer")), "answer")
    d = d.select("case_id", "edits", M.decode_edits(F.col("answer")).alias("got"))
    same = F.to_json("got.findings_edits") == F.to_json("edits.findings_edits")
    return d.select("case_id", F.col("got.error").alias("error"), same.alias("same_edits"))


# --- data contracts, log, resume ----------------------------------------------


@query
def dataset_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return V.dataset_report(corpus.all_cases(spark, sf_dir), expected=None)


@query
def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    skeleton = corpus.table(spark, sf_dir, "labels").select(
        F.lpad(F.col("doc_id").cast("string"), 12, "0").alias("case_id")
    )
    return V.contract(corpus.all_cases(spark, sf_dir), skeleton)


@query
def checkpoint_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines as JSON, some damaged, read back as typed records."""
    log = corpus.checkpoint_log(spark, sf_dir)
    line = F.to_json(F.struct(*[c for c in log.columns if c != "seq"])).alias("line")
    log, line, kind = T.once(corpus.spread(log).select("seq", line), "line"), F.col("line"), F.col("seq") % 16
    damaged = (
        F.when(kind == 3, F.left(line, F.length(line) - 9))
        .when(kind == 5, F.replace(line, F.lit('"row_index":'), F.lit('"row_index":"x","old":')))
        .when(kind == 7, F.replace(line, F.lit('"attempts":'), F.lit('"old":')))
        .otherwise(line)
    )
    lines = T.once(log.select("seq", damaged.alias("value")), "value")
    lines = lines.where(M.is_json(F.col("value")))
    d = C.valid_records(C.typed_records(lines))
    return d.select(
        "seq", "case_id", _big("row_index").alias("row_index"), "status", "report",
        _big("attempts").alias("attempts"), "latency_seconds", "error_category", "timestamp",
    )


def _state(spark, sf_dir):
    return C.latest_state(corpus.checkpoint_log(spark, sf_dir))


@query
def latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select(
        "case_id", "seq", "first_seq", "status", "report", _big("attempts").alias("attempts"),
        "latency_seconds", "error_category", "timestamp",
    )


@query
def state_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.state_counts(_state(spark, sf_dir))


@query
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = C.valid_records(corpus.checkpoint_log(spark, sf_dir))
    return log.agg(
        F.count_if(F.col("status") == "SUCCESS").alias("succeeded"),
        F.count_if(F.col("status") == "FAILED").alias("failed"),
        F.sum("attempts").alias("call_count"),
    )


@query
def resume_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = corpus.all_cases(spark, sf_dir).select("case_id", "row_index")
    return C.plan(cases, _state(spark, sf_dir), resume=True)


@query
def predictions_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = corpus.all_cases(spark, sf_dir).select("case_id", "row_index")
    return C.predictions(cases, _state(spark, sf_dir))


@query
def failures_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = corpus.all_cases(spark, sf_dir).select("case_id", "row_index")
    d = C.failures(cases, _state(spark, sf_dir))
    return d.withColumns({c: _big(c) for c in ("row_index", "attempts")})


@query
def submission_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = corpus.all_cases(spark, sf_dir).select("case_id", "row_index")
    return V.submission_errors(cases, _state(spark, sf_dir))


@query
def error_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Categories and retry decisions for error names and statuses, told from the type and properties of the events."""
    names = (
        "MockFailure", "InvalidModelOutput", "TimeoutError", "DeadlineExceeded", "TooManyRequests",
        "ClientError", "ServerError", "ConnectionResetError", "OSError", "Unavailable",
        "TemplateError", "ValueError",
    )
    statuses = (400, 401, 403, 404, 418, 429, 500, 502, 503, 504)
    pick = lambda values, key: F.element_at(
        F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int")
    )
    k = F.get_json_object("props", "$.k").cast("int")
    d = corpus.table(spark, sf_dir, "events").select(
        pick(names, F.length("event_type") + k).alias("name"), pick(statuses, F.floor(k / 10)).alias("status")
    )
    category = R.classify(F.col("name"), F.col("status"))
    d = d.select("name", _big("status").alias("status"), category.alias("category"))
    return d.groupBy("name", "status", "category").agg(F.count("*").alias("events")).withColumn(
        "retryable", R.is_retryable(F.col("category"))
    )


# --- routing ------------------------------------------------------------------


def _weights(d: DataFrame) -> DataFrame:
    return d.select("signal", "label", "weight")


@query
def routing_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(W.group_model(_analysis(spark, sf_dir, char_edits=False)))


@query
def routing_by_term(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weights(W.term_model(_analysis(spark, sf_dir, char_edits=False)))


def _train_model(spark, sf_dir):
    analysis = A.analyze(corpus.train_cases(spark, sf_dir), char_edits=False)
    return W.train(corpus.keep(analysis.select("modality", "body_part", "dictation", "edited")))


@query
def candidate_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hints for the unlabelled cases from a model of the labelled ones."""
    d = W.candidates(corpus.test_cases(spark, sf_dir), _train_model(spark, sf_dir), corpus.keep)
    return d.select("case_id", _joined("candidates").alias("candidates"))


# --- retrieval ----------------------------------------------------------------


def _retrieval_features(spark, sf_dir):
    index = S.index_features(corpus.train_cases(spark, sf_dir))
    todo = corpus.test_cases(spark, sf_dir)
    return S.query_features(todo, W.candidates(todo, _train_model(spark, sf_dir), corpus.keep)), index


@query
def retrieval_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best labelled cases for every unlabelled one."""
    cases, index = _retrieval_features(spark, sf_dir)
    return _rounded(S.retrieve(cases, index, keep=corpus.keep))


@query
def retrieval_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stored index, to which one case in a hundred is added later and another one was changed."""
    train, todo = corpus.train_cases(spark, sf_dir), corpus.test_cases(spark, sf_dir)
    part = F.pmod(F.xxhash64("case_id"), F.lit(100))
    changed = F.when(part == 1, F.lit("another dictation")).otherwise(F.col("dictation"))
    index = CaseIndex(spark, new_folder(spark, "case-index"))
    index.add(train.where(part != 0).withColumn("dictation", changed), "first")
    index.add(train.where(part < 2), "later")
    index.add(train.where(part < 2), "later")  # a repeated delivery changes nothing
    return _rounded(index.retrieve(S.query_features(todo, W.candidates(todo, _train_model(spark, sf_dir), corpus.keep))))


def _rounded(d: DataFrame) -> DataFrame:
    rounded = [
        F.round(c, 6).alias(c)
        for c in ("template_similarity", "modality_bodypart", "dictation_similarity", "edited_section_relevance", "score")
    ]
    return d.select("case_id", _big("rank").alias("rank"), "match_id", _big("tier").alias("tier"), *rounded)


@query
def retrieval_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nearest other case for every case of the whole corpus."""
    cases = S.profiled(S.case_features(corpus.all_cases(spark, sf_dir)))
    cases = corpus.keep(S.asking(cases.withColumn("candidates", F.array().cast("array<string>"))))
    d = S.retrieve(cases, cases.where("edited IS NOT NULL"), k=1, keep=corpus.keep, signals=False)
    return d.select("case_id", "match_id", _big("tier").alias("tier"))


@query
def tfidf_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = S.index_features(corpus.all_cases(spark, sf_dir)).select("case_id", "spoken")
    index = corpus.keep(index)
    norms = S.vector_norms(index, S.idf_weights(index, index.count()), "case_id")
    return norms.select("case_id", F.round("norm", 6).alias("norm"))


@query
def modality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement between the keys of unlabelled and labelled cases that share a modality or a word of the body part."""
    keys = lambda d: d.select("modality", "body_part").distinct()
    q, i = keys(corpus.test_cases(spark, sf_dir)), keys(corpus.train_cases(spark, sf_dir))
    i = i.select(F.col("modality").alias("im"), F.col("body_part").alias("ib"))
    by_word = [
        d.withColumn("word", F.explode(X.body_part_tokens(F.col(c)))) for d, c in ((q, "body_part"), (i, "ib"))
    ]
    met = q.join(i, F.col("modality") == F.col("im")).unionAll(
        q.join(i, F.lower("body_part") == F.lower("ib"))
    ).unionAll(by_word[0].join(by_word[1], "word").drop("word")).distinct()
    score = S.modality_score(F.col("modality"), F.col("body_part"), F.col("im"), F.col("ib"))
    return met.select(
        "modality", "body_part", F.col("im").alias("index_modality"), F.col("ib").alias("index_body_part"),
        F.round(score, 6).alias("score"),
    )


@query
def near_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of template similarity between unlabelled and labelled cases."""
    cases, index = _retrieval_features(spark, sf_dir)
    pick = lambda d: corpus.keep(S._profiles(d).select("case_id", "tsig", "lsig", "labels", "words"))
    q, i = pick(cases), pick(index)
    near = S.near_templates(q, i, corpus.keep)
    d = q.select(F.col("tsig").alias("qt"), "case_id").join(near, "qt").join(
        i.select(F.col("tsig").alias("it"), F.col("case_id").alias("match_id")), "it"
    )
    return d.groupBy("case_id", _big("tier").alias("tier")).agg(F.count("*").alias("matches"))


@query
def label_order_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order similarity of template and report labels, on distinct pairs."""
    d = T.parse(T.parse(corpus.all_cases(spark, sf_dir), "template_content", "t"), "report", "r")
    d = d.where(F.col("t_error").isNull() & F.col("r_error").isNull())
    pairs = d.select(T.labels(F.col("t_sections")).alias("a"), T.labels(F.col("r_sections")).alias("b"))
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("cases"))
    ratio = diffing.label_order_ratio("a", "b")
    return pairs.select(_joined("a").alias("template"), _joined("b").alias("report"), "cases", ratio.alias("ratio"))


# --- prompts ------------------------------------------------------------------


@query
def prompt_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the prompts of the unlabelled cases, with hints and one fixed example."""
    todo = corpus.test_cases(spark, sf_dir)
    shot = {
        "template": "FINDINGS:\nBONES: Normal.\n\nIMPRESSION:\nNormal.",
        "dictation": "broken",
        "output": {"findings_edits": {"BONES": "Broken."}, "impression": None},
    }
    hints = W.candidates(todo, _train_model(spark, sf_dir), corpus.keep)
    d = P.build(todo, "Edit the template.", examples=[shot], candidates=hints)
    return T.explode(d.select("case_id", "turns"), "turns", "t").select(
        "case_id", _big("position").alias("turn"), "t.role", "t.text"
    )


@query
def example_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every labelled case as a numbered example: its task and its edits as JSON."""
    d = E.editable(E.with_derived_edits(corpus.train_cases(spark, sf_dir)))
    turns = P.example_turns(F.col("template_content"), F.col("dictation"), F.col("edits"), F.lit(1))
    d = T.explode(d.select("case_id", turns.alias("turns")), "turns", "t")
    return d.select("case_id", _big("position").alias("turn"), "t.role", "t.text")


@query
def retrieval_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of the prompts of the unlabelled cases, with hints and their nearest labelled cases."""
    builder = PromptBuilder(
        "Edit the template.", corpus.train_cases(spark, sf_dir), corpus.keep(_train_model(spark, sf_dir))
    )
    d = builder(corpus.test_cases(spark, sf_dir))
    return T.explode(d.select("case_id", "turns"), "turns", "t").select(
        "case_id", _big("position").alias("turn"), "t.role", "t.text"
    )
