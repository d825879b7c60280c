"""Labelled cases derived from the ``documents`` table.

Each document becomes one case: its whole text, line by line, is the template,
the report edits some of those lines and the dictation speaks the new ones.
Every rule is a plain column expression over one row, so the derivation runs
without a shuffle and grows with the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.functions import text as X
from redline.sources.shared import keep, shared_folder, table  # noqa: F401

VOCABULARY = (
    "LUNGS", "PLEURAL SPACES", "HEART", "MEDIASTINUM/HILA",
    "L1-L2", "SOFT TISSUES (DEEP)", "BONES & JOINTS", "OTHER FINDINGS",
)
PART_SUFFIXES = (" spine", " joint", " bone", " region", "")


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows of a small input out to all cores.

    Work per text is heavy, and one row group is one task.  An input with
    enough splits, as any large one, is left alone and not shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def _string(c: Column) -> Column:
    return c.cast("string")


def _label(i: Column) -> Column:
    """Label of the i-th section (from 1): the vocabulary, numbered on reuse."""
    n = len(VOCABULARY)
    word = F.element_at(F.array(*[F.lit(w) for w in VOCABULARY]), (i - 1) % n + 1)
    turn = F.floor((i - 1) / n) + 1
    return F.when(i > n, F.concat(word, F.lit(" "), _string(turn))).otherwise(word)


def labelled_cases(documents: DataFrame) -> DataFrame:
    """``row_index``, the case columns and ``report`` for every document."""
    doc = F.col("doc_id")
    shape = F.col("num") % 10
    marks = {2: "[left/right] ", 5: "[ and stable] ", 6: "[left/right/bilateral] "}
    mark = F.lit("")
    for key, value in marks.items():
        mark = F.when(shape == key, value).otherwise(mark)
    separator = F.when(shape == 4, "\n\n").otherwise("\n")
    colon = F.when(shape == 4, ":\n").otherwise(": ")

    def heading(i: Column, label: Column) -> Column:
        return F.when(shape == 0, F.lit("")).otherwise(F.concat(label, colon))

    def marked(i: Column, line: Column) -> Column:
        return F.when(i == 1, F.concat(mark, line)).otherwise(line)

    def kind(i: Column) -> Column:
        return (doc + 3 * i) % 12

    def spoken(lines: Column, i: Column) -> Column:
        other = F.element_at(lines, (F.size(lines) + 1 - i).cast("int"))
        return F.concat(other, F.lit(" Measures "), _string(doc % 90 + i), F.lit(".5 mm."))

    def template_part(line: Column, i0: Column) -> Column:
        i = i0 + 1
        return F.concat(heading(i, _label(i)), marked(i, line))

    def report_parts(lines: Column, line: Column, i0: Column) -> Column:
        i = i0 + 1
        same, head = marked(i, line), heading(i, _label(i))
        return (
            F.when(kind(i) <= 2, F.array(F.concat(head, spoken(lines, i))))
            .when((kind(i) == 3) & (i > 1), F.array().cast("array<string>"))
            .when(kind(i) == 4, F.array(F.concat(heading(i, F.concat(F.lit("MOVED "), _string(i))), same)))
            .when(kind(i) == 5, F.array(F.concat(head, F.replace(same, F.lit(" "), F.lit("  ")))))
            .when(kind(i) == 6, F.array(F.concat(head, same), F.concat(head, F.lit("Again "), line)))
            .otherwise(F.array(F.concat(head, same)))
        )

    d = (
        documents.select(
            "doc_id", "lang", "source", "n_chars",
            F.coalesce(F.expr("try_cast(regexp_extract(source, '[0-9]+', 0) AS INT)"), F.lit(0)).alias("num"),
            F.filter(F.split("text", "\n", -1), lambda s: X.strip(s) != "").alias("lines"),
        )
        .withColumn(
            "conclusion",
            F.concat(
                F.when(shape == 3, "Normal [generic] spine. ")
                .when(shape == 5, "Seen in the [_laterality_] part. ").otherwise(""),
                F.coalesce(F.try_element_at("lines", F.lit(-1)), F.lit("")),
            ),
        )
        .withColumn("parts", F.call_function("array_join", F.transform("lines", template_part), separator))
        .withColumn(
            "new_parts",
            F.call_function("array_join", X.bind(
                F.col("lines"),
                lambda v: F.flatten(F.transform(v, lambda line, i: report_parts(v, line, i))),
            ), separator),
        )
        .withColumn(
            "words",
            F.array_join(
                X.bind(
                    F.col("lines"),
                    lambda v: F.array_compact(
                        F.transform(v, lambda _, i0: F.when(kind(i0 + 1) <= 2, spoken(v, i0 + 1)))
                    ),
                ),
                " ",
            ),
        )
    )
    group = F.when(shape == 1, "GROUP: \n").otherwise("")
    opening = F.when(F.col("num") == 19, "FINDINGS\n").otherwise("FINDINGS:\n")
    ending = F.when((F.col("num") == 18) & (doc % 5 == 0), "\nIMPRESSION: again").otherwise("")
    new_conclusion = (
        F.when(doc % 15 == 7, F.lit(""))
        .when(doc % 3 == 0, F.concat("conclusion", F.lit(" Stable since prior.")))
        .when(doc % 3 == 2, F.concat(F.lit("  "), "conclusion", F.lit(" \n")))
        .otherwise(F.col("conclusion"))
    )
    report = F.concat(
        F.lit("FINDINGS:\n"), group, "new_parts", F.lit("\n\nIMPRESSION:\n"), new_conclusion
    )
    resolved = report
    for token, word in (
        ("[left/right]", "left"), ("[left/right/bilateral]", "right"),
        ("[_laterality_]", "left"), ("[generic]", "lumbar"),
    ):
        resolved = F.replace(resolved, F.lit(token), F.lit(word))
    sides = (" left", " left and right", " bilateral leftover", " Right side, right_ Right", "")
    side = F.element_at(F.array(*[F.lit(s) for s in sides]), (doc % 5 + 1).cast("int"))
    suffix = F.element_at(
        F.array(*[F.lit(s) for s in PART_SUFFIXES]), (F.col("num") % 5 + 1).cast("int")
    )
    return d.select(
        F.col("doc_id").alias("row_index"),
        F.lpad(_string(doc), 12, "0").alias("case_id"),
        F.upper("lang").alias("modality"),
        F.concat("source", suffix).alias("body_part"),
        F.concat(F.lit("Document of "), "source").alias("study_description"),
        _string(F.floor(F.col("n_chars") / 1000)).alias("patient_age_band"),
        F.when(doc % 2 == 0, "female").otherwise("male").alias("patient_sex"),
        F.concat(
            opening, group, "parts", F.lit("\n\nIMPRESSION:\n"), "conclusion", ending
        ).alias("template_content"),
        F.concat(
            F.when(F.col("words") == "", F.lit("norml")).otherwise(F.col("words")),
            side,
            F.when(doc % 4 == 0, F.lit(" Size 12.5 cm and 120 mmHg.")).otherwise(""),
        ).alias("dictation"),
        F.when(doc % 2 == 0, resolved).otherwise(report).alias("report"),
    )


def all_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled_cases(spread(table(spark, sf_dir, "documents")))


def train_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases of the documents that carry a label."""
    known = table(spark, sf_dir, "labels").select("doc_id").distinct()
    docs = spread(table(spark, sf_dir, "documents"))
    return labelled_cases(docs.join(known, "doc_id", "left_semi"))


def test_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cases still without a label."""
    known = table(spark, sf_dir, "labels").select("doc_id")
    docs = spread(table(spark, sf_dir, "documents"))
    return labelled_cases(docs.join(known, "doc_id", "left_anti")).drop("report")


def checkpoint_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream read as an append-only log of case outcomes."""
    failed = F.col("event_type") == "error"
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"),
        F.lpad(_string(F.col("user_id")), 12, "0").alias("case_id"),
        F.col("user_id").cast("int").alias("row_index"),
        F.when(failed, "FAILED").when(F.col("event_type") == "signup", "PENDING")
        .otherwise("SUCCESS").alias("status"),
        F.when(failed, F.lit("")).when(
            F.col("event_type") == "view",
            F.concat(F.lit("FINDINGS:\n[x] "), "props", F.lit("\nIMPRESSION:\nok")),
        ).when(F.col("value") < 5, F.lit(" \n")).otherwise(
            F.concat(F.lit("FINDINGS:\n"), "props", F.lit("\nIMPRESSION:\nok"))
        ).alias("report"),
        F.get_json_object("props", "$.k").cast("int").alias("attempts"),
        F.round("value", 3).alias("latency_seconds"),
        F.when(failed, F.lit("TIMEOUT")).alias("error_category"),
        F.when(failed, F.concat(F.lit("TimeoutError: "), "props")).alias("error_message"),
        F.lit("mock").alias("model"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.lit("").alias("warnings"),
    )
