"""Templates and reports as structured columns.

A text is cut in front of every section header with one linear regular
expression.  A chunk keeps its raw text, so an edit can replace one chunk and
leave all others byte for byte.  Texts that break the structure give a null
``region`` and a message in ``error`` instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline import constants as K
from redline.functions import text as X

_BEFORE_HEADER = f"\n(?={K.HEADER_RE})"
_AT_HEADER = f"^({K.HEADER_RE[:-1]}):"
# A label has no colon, so the first one ends it.
_LABEL_AND_BLANKS = r"(?U)^[^:]*:[\s\x1c-\x1f&&[^\n]]*"


def impression_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit(K.IMPRESSION))


def is_valid(c: Column) -> Column:
    """Cheap structure test on the raw text, fit for filters."""
    t = X.text(c)
    return F.startswith(t, F.lit(K.FINDINGS)) & (impression_count(t) == 1)


def structure_error(c: Column) -> Column:
    t = X.text(c)
    n = impression_count(t)
    return F.when(
        ~F.startswith(t, F.lit(K.FINDINGS)), F.lit("TemplateError: text does not open with FINDINGS:")
    ).when(
        n != 1,
        F.concat(F.lit("TemplateError: one IMPRESSION: expected, found "), n.cast("string")),
    )


def region(c: Column) -> Column:
    """Text between the two block headers of a valid text; cut at the header, so no characters are counted up to it."""
    return F.substr(F.substring_index(c, K.IMPRESSION, 1), F.lit(len(K.FINDINGS) + 1))


def after_impression(c: Column) -> Column:
    """Text behind the second block header of a valid text."""
    return F.substring_index(c, K.IMPRESSION, -1)


def is_header(chunk: Column) -> Column:
    return F.rlike(chunk, F.lit(_AT_HEADER))


def label_of(chunk: Column) -> Column:
    """Label of a chunk that opens with a header."""
    return F.substring_index(chunk, ":", 1)


def body_of(chunk: Column) -> Column:
    """Body of a chunk that opens with a header."""
    return X.strip_newlines(F.regexp_replace(chunk, _LABEL_AND_BLANKS, ""))


def _section(chunk: Column) -> Column:
    return F.struct(label_of(chunk).alias("label"), body_of(chunk).alias("body"), chunk.alias("raw"))


def chunks(region_text: Column) -> Column:
    return F.split(region_text, _BEFORE_HEADER, -1)


def sections_of(chunk_array: Column) -> Column:
    """Array of (label, body, raw); only the first chunk can lack a header."""
    return F.transform(F.filter(chunk_array, is_header), _section)


def headed(chunk_array: Column) -> Column:
    """Array of (label, raw): sections whose bodies are not cut out."""
    return F.transform(
        F.filter(chunk_array, is_header), lambda c: F.struct(label_of(c).alias("label"), c.alias("raw"))
    )


def parse(df: DataFrame, column: str, prefix: str) -> DataFrame:
    """Add ``{prefix}_error|region|after|chunks|sections`` for a text column."""
    c, valid = F.col(column), F.col(f"{prefix}_error").isNull()
    return (
        df.withColumn(f"{prefix}_error", structure_error(c))
        .withColumns(
            {
                f"{prefix}_region": F.when(valid, region(c)),
                f"{prefix}_after": F.when(valid, after_impression(c)),
            }
        )
        .withColumn(f"{prefix}_chunks", chunks(F.col(f"{prefix}_region")))
        .withColumn(f"{prefix}_sections", sections_of(F.col(f"{prefix}_chunks")))
    )


def labels(sections: Column) -> Column:
    return F.transform(sections, lambda s: s["label"])


def names(c: Column) -> Column:
    """Labels of a text without its bodies; null if it cannot be parsed."""
    found = F.filter(chunks(F.when(is_valid(c), region(c))), is_header)
    return F.transform(found, label_of)


def having(df: DataFrame, column: str) -> DataFrame:
    """Rows in which a column is not null.

    Not a filter: the optimizer would move its condition below the parsing, down
    to the source, and compute the texts a second time there.
    """
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(F.array_compact(F.array(column))).alias(column))


def once(df: DataFrame, column: str) -> DataFrame:
    """The same rows with a column that is computed once, however often and in whatever filter it is read."""
    keep = [c for c in df.columns if c != column]
    return df.select(*keep, F.explode(F.array(column)).alias(column))


def last_wins(sections: Column) -> Column:
    """One entry per label: the last body at the first position."""

    def merge(backwards: Column) -> Column:
        names = F.reverse(labels(backwards))
        merged = X.bind(
            labels(backwards),
            lambda found: F.transform(
                F.array_distinct(names),
                lambda n: F.element_at(backwards, F.array_position(found, n).cast("int")),
            ),
        )
        unique = F.size(F.array_distinct(names)) == F.size(names)
        return F.when(unique, F.reverse(backwards)).otherwise(merged)

    return X.bind(F.reverse(sections), merge)


def body_map(unique_sections: Column, text: str = "body") -> Column:
    return F.map_from_entries(
        F.transform(unique_sections, lambda s: F.struct(s["label"], s[text]))
    )


def explode(df: DataFrame, array: str, item: str) -> DataFrame:
    """One row per element, with its ``position``, in place of an array column.

    The outer form keeps the optimizer from putting a filter on the array below
    the explode, which would compute the array a second time.
    """
    keep = [c for c in df.columns if c != array]
    rows = df.select(*keep, F.posexplode_outer(array).alias("position", item))
    return rows.where(F.col("position").isNotNull())


def explode_sections(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """One row per section with its line span inside the region.

    ``start_line`` counts from 0, ``end_line`` is exclusive and leaves out the
    empty lines that separate a section from the next one.
    """
    parsed = parse(df, column, "t").where(F.col("t_error").isNull())
    # Lines before each chunk, carried along the array in one pass.
    spans = F.aggregate(
        "t_chunks",
        F.struct(F.lit(0).alias("line"), F.array().cast("array<int>").alias("starts")),
        lambda acc, chunk: F.struct(
            (acc["line"] + F.length(chunk) - F.length(F.replace(chunk, F.lit("\n"))) + 1).alias("line"),
            F.array_append(acc["starts"], acc["line"]).alias("starts"),
        ),
        lambda acc: acc["starts"],
    )
    offset = F.size("t_chunks") - F.size("t_sections")
    rows = parsed.withColumn("_starts", F.slice(spans, offset + 1, F.size("t_sections")))
    rows = explode(rows.select(*keys, "_starts", "t_sections"), "t_sections", "section")
    kept = F.rtrim(F.col("section.raw"), F.lit("\n"))
    start = F.get("_starts", F.col("position"))
    height = F.length(kept) - F.length(F.replace(kept, F.lit("\n"))) + 1
    return rows.select(
        *keys,
        "position",
        F.col("section.label").alias("label"),
        F.col("section.body").alias("body"),
        start.alias("start_line"),
        (start + height).alias("end_line"),
    )
