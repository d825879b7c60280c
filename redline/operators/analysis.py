"""How finished reports differ from their templates: per row and over the corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.functions import text as X
from redline.functions.diffing import python_round, with_char_edits
from redline.operators import template as T

_NO_LABELS = "array<string>"


def classify(df: DataFrame) -> DataFrame:
    """Add ``edited``, ``unchanged`` and ``added`` label arrays.

    Expects ``t_*`` and ``r_*`` as written by :func:`template.parse`.  A label
    the report kept is edited when its body differs; one it lost is edited
    unless its body stands somewhere in the report's findings.
    """
    against = F.struct(
        T.body_map(T.last_wins(F.col("r_sections"))).alias("bodies"),
        X.normalize(F.col("r_region")).alias("text"),
    )

    def verdict(report: Column, section: Column) -> Column:
        kept = F.map_contains_key(report["bodies"], section["label"])
        same = F.when(
            kept, X.same(section["body"], F.try_element_at(report["bodies"], section["label"]))
        ).otherwise(X.contains_normalized(X.normalize(section["body"]), report["text"]))
        return F.struct(section["label"].alias("label"), same.alias("same"))

    d = df.withColumn(
        "_verdict",
        X.bind(
            against,
            lambda r: F.transform(T.last_wins(F.col("t_sections")), lambda s: verdict(r, s)),
        ),
    )
    pick = lambda keep: T.labels(F.filter("_verdict", keep))
    template, report = T.labels(F.col("t_sections")), T.labels(F.col("r_sections"))
    # array_except hashes but drops repeats, which are rare and then looked up one by one
    added = F.when(
        F.size(F.array_distinct(report)) == F.size(report), F.array_except(report, template)
    ).otherwise(X.bind(template, lambda names: F.filter(report, lambda n: ~F.array_contains(names, n))))
    verdicts = {"edited": pick(lambda v: ~v["same"]), "unchanged": pick(lambda v: v["same"])}
    return d.withColumns({**verdicts, "added": added}).drop("_verdict")


def analyze(df: DataFrame, *, char_edits: bool = True) -> DataFrame:
    """Measurements of each labelled case.

    A row whose template or report cannot be parsed keeps its ids and gets
    zeros, as the corpus statistics count it.
    """
    d = T.parse(T.parse(df, "template_content", "t"), "report", "r")
    d = classify(d)
    ok = F.col("t_error").isNull() & F.col("r_error").isNull()
    differ = lambda a, b: ~X.same(F.col(a), F.col(b))
    none = F.array().cast(_NO_LABELS)
    present = X.placeholders_in(F.col("template_content"))
    labels = {n: F.when(ok, F.col(n)).otherwise(none) for n in ("edited", "unchanged", "added")}
    d = d.withColumns(
        {
            "parsed": ok,
            "findings_changed": ok & differ("t_region", "r_region"),
            "impression_changed": ok & differ("t_after", "r_after"),
            "sectioned": ~ok | (F.size("t_sections") > 0),
            "template_section_count": F.when(ok, F.size("t_sections")).otherwise(0),
            "template_labels": F.when(ok, T.labels(F.col("t_sections"))).otherwise(none),
            "template_placeholders": F.when(ok, present).otherwise(none),
            **labels,
        }
    )
    d = d.withColumn(
        "unresolved_placeholders",
        X.bind(
            F.col("report"),
            lambda r: F.filter("template_placeholders", lambda p: F.contains(r, p)),
        ),
    ).withColumn(
        "resolved_placeholder_count",
        F.size("template_placeholders") - F.size("unresolved_placeholders"),
    )
    if char_edits:
        d = with_char_edits(d, "template_content", "report")
        for name, zero in (("char_edit_ratio", 0.0), ("added_chars", 0), ("deleted_chars", 0)):
            d = d.withColumn(name, F.when(F.col("parsed"), F.col(name)).otherwise(F.lit(zero)))
        d = d.withColumn(
            "preserved_exactly",
            F.col("parsed") & (F.col("added_chars") + F.col("deleted_chars") == 0)
            & (F.size("edited") == 0),
        )
    drop = [f"{p}_{n}" for p in "tr" for n in ("error", "region", "after", "chunks", "sections")]
    return d.drop(*drop)


# Digits of the means and percentages.
_DIGITS = {
    "average_edited_sections": 3, "percent_mostly_unchanged": 2, "percent_low_char_edit_ratio": 2,
    "average_char_edit_ratio": 4, "average_added_chars": 2, "average_deleted_chars": 2,
}


def _count(condition: Column, name: str) -> Column:
    return F.count_if(condition).alias(name)


def corpus_stats(analysis: DataFrame, *, char_edits: bool = True) -> DataFrame:
    """One row of corpus statistics, in a single pass over the analysis.

    On an empty corpus the counts are 0 and the means null.
    """
    n = F.size("edited")
    findings, impression = F.col("findings_changed"), F.col("impression_changed")
    sections = F.col("template_section_count")
    percent = lambda c: F.count_if(c) / F.count("*") * 100
    columns = [
        F.count("*").alias("total_cases"),
        _count(findings, "findings_edited"),
        _count(~findings, "findings_unchanged"),
        _count(impression, "impression_edited"),
        _count(~impression, "impression_unchanged"),
        F.avg(n).alias("average_edited_sections"),
        # Counts of sections are few, so the exact median works on a small histogram.
        F.median(n).alias("median_edited_sections"),
        _count(n == 0, "zero_section_edits"),
        _count(n == 1, "one_section_edit"),
        _count(n >= 2, "multi_section_edits"),
        _count(impression & ~findings, "only_impression_changed"),
        _count(findings & ~impression, "only_findings_changed"),
        _count(findings & impression, "both_changed"),
        percent((sections > 0) & (F.size("unchanged") >= sections / 2)).alias(
            "percent_mostly_unchanged"
        ),
        _count(F.size("template_placeholders") > 0, "cases_with_placeholder"),
        _count(F.size("unresolved_placeholders") > 0, "cases_with_unresolved_placeholder"),
    ]
    if char_edits:
        columns += [
            percent(F.col("char_edit_ratio") <= 0.5).alias("percent_low_char_edit_ratio"),
            F.avg("char_edit_ratio").alias("average_char_edit_ratio"),
            F.avg("added_chars").alias("average_added_chars"),
            F.avg("deleted_chars").alias("average_deleted_chars"),
        ]
    row = analysis.agg(*columns)
    return row.withColumns(
        {c: python_round(F.col(c), F.lit(digits)) for c, digits in _DIGITS.items() if c in row.columns}
    )


def exact_median(df: DataFrame, column: str, bins: int = 1 << 16) -> DataFrame:
    """Exact median of a ratio in [0, 1] as one row; null when there is none.

    Counts per bin say which bins hold the middle ranks.  Only those are then
    counted value by value, so no task ever holds the whole column.
    """
    value = F.col(column).cast("double")
    d = df.where(value.isNotNull()).select(
        value.alias("v"), F.floor(value * bins).cast("int").alias("bin")
    )
    counts = d.groupBy("bin").agg(F.count("*").alias("n"))
    # At most bins + 1 rows are ordered here, whatever the size of the data.
    upto = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.select(
        "bin", (F.sum("n").over(upto) - F.col("n")).alias("before"), "n",
        F.sum("n").over(Window.partitionBy()).alias("total"),
    )
    low, high = F.floor((F.col("total") + 1) / 2), F.floor(F.col("total") / 2) + 1
    middle = placed.where(
        ((F.col("before") < low) & (low <= F.col("before") + F.col("n")))
        | ((F.col("before") < high) & (high <= F.col("before") + F.col("n")))
    ).select("bin", "before", low.alias("low"), high.alias("high"))
    values = (
        d.join(F.broadcast(middle), "bin")  # two bins at most
        .groupBy("bin", "before", "low", "high", "v").agg(F.count("*").alias("n"))
    )
    inside = Window.partitionBy("bin").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    end = F.col("before") + F.sum("n").over(inside)
    ranked = values.select("v", "low", "high", (end - F.col("n")).alias("from"), end.alias("to"))
    at = lambda rank: F.max(
        F.when((F.col("from") < F.col(rank)) & (F.col(rank) <= F.col("to")), F.col("v"))
    )
    return ranked.agg(((at("low") + at("high")) / 2).alias("median"))


def edit_histogram(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy(F.size("edited").alias("edited_sections")).agg(
        F.count("*").alias("cases")
    )


def top_labels(analysis: DataFrame, order: Column, k: int = 20) -> DataFrame:
    """Most edited labels; ties go to the label met first in corpus order."""
    seen = T.explode(analysis.select(order.alias("_row"), "edited"), "edited", "label")
    counts = seen.groupBy("label").agg(
        F.count("*").alias("edits"), F.min(F.struct("_row", "position")).alias("_first")
    )
    top = counts.orderBy(F.desc("edits"), "_first").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("edits"), "_first"))
    return top.select(rank.alias("rank"), "label", "edits")


def placeholder_counts(analysis: DataFrame) -> DataFrame:
    found = analysis.select(F.array_distinct("template_placeholders").alias("p"))
    return T.explode(found, "p", "placeholder").groupBy("placeholder").agg(
        F.count("*").alias("cases")
    )


def group_key() -> Column:
    return F.concat_ws(" / ", "modality", "body_part")


def edit_rate_by_group(analysis: DataFrame) -> DataFrame:
    return analysis.groupBy(group_key().alias("group")).agg(
        F.count_if("findings_changed").alias("findings_edited"), F.count("*").alias("total")
    )


def edit_summary(df: DataFrame, *, char_edits: bool = True) -> DataFrame:
    """Per-case measures for the details log; null where a text cannot be parsed.

    Unlike :func:`classify`, bodies are only trimmed, every template section
    counts, a lost label is an edit, and the first of equal report labels counts.
    """
    d = T.parse(T.parse(df, "template_content", "t"), "report", "r")
    ok = F.col("t_error").isNull() & F.col("r_error").isNull()
    edited = X.bind(
        T.body_map(T.last_wins(F.reverse("r_sections"))),
        lambda known: T.labels(
            F.filter(
                "t_sections",
                lambda s: ~F.map_contains_key(known, s["label"])
                | (X.strip(s["body"]) != X.strip(X.text(F.try_element_at(known, s["label"])))),
            )
        ),
    )
    d = (
        d.withColumn("edited_sections", F.when(ok, edited))
        .withColumn("edited_section_count", F.when(ok, F.size("edited_sections")))
        .withColumn(
            "impression_changed", F.when(ok, X.strip(F.col("t_after")) != X.strip(F.col("r_after")))
        )
    )
    if char_edits:
        d = with_char_edits(d, "template_content", "report").withColumn(
            "char_edit_ratio", F.when(ok, F.round("char_edit_ratio", 4))
        ).drop("added_chars", "deleted_chars")
    drop = [f"{p}_{n}" for p in "tr" for n in ("error", "region", "after", "chunks", "sections")]
    return d.drop(*drop)
