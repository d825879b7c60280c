"""Corpus statistics as one document and as a text table."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.operators import analysis as A
from redline.plans import corpus


def corpus_statistics(analysis: DataFrame) -> tuple[dict, DataFrame]:
    """The aggregates of bounded size, and the table of groups, which is written row by row."""
    d = corpus.keep(
        analysis.select(
            "row_index", "modality", "body_part", "findings_changed", "impression_changed", "edited",
            "unchanged", "template_section_count", "template_placeholders", "unresolved_placeholders",
            "char_edit_ratio", "added_chars", "deleted_chars",
        )
    )
    stats = A.corpus_stats(d).first().asDict()
    if not stats["total_cases"]:
        raise ValueError("no labelled cases to analyse")
    stats["median_char_edit_ratio"] = A.exact_median(d, "char_edit_ratio").first()["median"]
    # one row for each number of sections in a document, and one for each kind of placeholder
    histogram = A.edit_histogram(d).orderBy("edited_sections").toLocalIterator()
    stats["edited_section_counts"] = {str(r["edited_sections"]): r["cases"] for r in histogram}
    top = A.top_labels(d, F.col("row_index")).orderBy("rank").collect()
    stats["top_labels"] = [[r["label"], r["edits"]] for r in top]
    stats["placeholders"] = {r["placeholder"]: r["cases"] for r in A.placeholder_counts(d).toLocalIterator()}
    return stats, corpus.keep(A.edit_rate_by_group(d).orderBy("group"))


def json_document(stats: dict, groups: DataFrame) -> Iterator[str]:
    """The document in pieces, the groups one at a time."""
    yield json.dumps(stats, indent=2, ensure_ascii=False)[:-2] + ',\n  "by_group": {'
    mark = "\n"
    for r in groups.orderBy("group").toLocalIterator():
        value = {"findings_edited": r["findings_edited"], "total": r["total"]}
        yield f"{mark}    {json.dumps(r['group'], ensure_ascii=False)}: " + json.dumps(value, indent=2).replace("\n", "\n    ")
        mark = ",\n"
    yield "\n  }\n}"


def text_report(stats: dict, groups: DataFrame) -> Iterator[str]:
    """The text table in pieces, the groups one at a time."""
    yield "Edits between templates and reports\n\n"
    for name, value in stats.items():
        title = name.replace("_", " ")
        if isinstance(value, dict):
            yield f"\n{title}\n" + "".join(f"  {k:<36} {v}\n" for k, v in value.items())
        elif isinstance(value, list):
            yield f"\n{title}\n" + "".join(f"  {label:<36} {n}\n" for label, n in value)
        else:
            yield f"{title:<44} {value}\n"
    yield "\nby group\n"
    for r in groups.orderBy("group").toLocalIterator():
        yield f"  {r['group']:<36} {r['findings_edited']}/{r['total']}\n"
