"""Checks of reports, data sets and submissions; findings are data, not exceptions."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline import constants as K
from redline.functions import text as X
from redline.operators import template as T
from redline.operators.errors import DataValidationError


def quoted_spans(c: Column) -> Column:
    return F.array_join(
        F.transform(X.bracket_spans(c), lambda s: F.concat(F.lit("'"), s, F.lit("'"))), ", "
    )


def split_blocks(report: Column) -> Column:
    """Struct (findings, impression) by whole-line headers, or null when broken."""

    def blocks(lines: Column) -> Column:
        at = F.array_position(lines, F.lit(K.IMPRESSION)).cast("int")
        return F.when(
            (F.get(lines, F.lit(0)) == K.FINDINGS) & (at > 0),
            F.struct(
                F.array_join(F.slice(lines, F.lit(2), F.greatest(at - 2, F.lit(0))), "\n").alias("findings"),
                F.array_join(F.slice(lines, at + 1, F.size(lines) - at), "\n").alias("impression"),
            ),
        )

    return X.bind(F.split(report, "\n", -1), blocks)


def duplicate_labels(findings: Column) -> Column:
    """Labels that head more than one line, sorted."""
    heads = F.transform(
        X.split_lines(findings), lambda line: F.regexp_extract(line, T._AT_HEADER, 1)
    )
    return X.bind(
        F.array_sort(F.filter(heads, lambda h: h != "")),
        lambda names: F.array_distinct(
            F.filter(names, lambda n, i: (i > 0) & (n == F.get(names, i - 1)))
        ),
    )


def validate_reports(df: DataFrame) -> DataFrame:
    """Add ``errors`` (the report is unusable) and ``warnings`` from report and dictation."""
    report = X.text(F.col("report"))
    d = df.withColumn("_blocks", split_blocks(report))
    blocks, filled = F.col("_blocks"), ~X.is_blank(F.col("report"))
    broken = filled & blocks.isNull()
    spans = quoted_spans(report)
    errors = F.array_compact(
        F.array(
            F.when(~filled, F.lit("report is empty")),
            F.when(
                filled & (spans != ""),
                F.concat(F.lit("report holds bracketed placeholder or template text: "), spans),
            ),
            F.when(broken, F.lit("report lacks its FINDINGS: or IMPRESSION: header line")),
            F.when(
                filled & (X.strip_newlines(blocks["findings"]) == ""), F.lit("empty FINDINGS block")
            ),
            F.when(filled & (X.strip(blocks["impression"]) == ""), F.lit("empty IMPRESSION")),
        )
    )

    def note(text: str, items: Column) -> Column:
        return X.bind(
            items,
            lambda v: F.when(filled & (F.size(v) > 0), F.concat(F.lit(text), X.quoted_list(v))),
        )

    warnings = F.array_compact(
        F.array(
            note("unresolved placeholder(s) in report: ", X.placeholders_in(report)),
            note("duplicate section label(s) in report: ", duplicate_labels(blocks["findings"])),
            note(
                "measured value(s) of the dictation absent from report: ",
                X.missing_measurements(F.col("dictation"), F.col("report")),
            ),
        )
    )
    return d.withColumn("errors", errors).withColumn("warnings", warnings).drop("_blocks")


def dataset_report(df: DataFrame, expected: int | None = K.EXPECTED_CASES) -> DataFrame:
    """One row with every count the data contract needs; missing columns count as null."""
    have = [c for c in K.NON_BLANK_COLUMNS if c in df.columns]
    columns = [F.count("*").alias("rows")]
    if "case_id" in df.columns:
        columns.append((F.count("*") - F.count_distinct(X.text(F.col("case_id")))).alias("duplicate_ids"))
    columns += [F.count_if(X.is_blank(F.col(c))).alias(f"blank_{c}") for c in have]
    counted = df.agg(*columns)
    return counted if expected is None else counted.withColumn(
        "unexpected_rows", (F.col("rows") - expected).cast("bigint")
    )


def check_dataset(df: DataFrame, expected: int | None = K.EXPECTED_CASES) -> None:
    """Raise one error that lists every violation of the data contract."""
    faults = []
    missing = sorted(set(K.CASE_COLUMNS) - set(df.columns))
    if missing:
        faults.append(f"missing columns {missing}")
    row = dataset_report(df, expected).first().asDict()
    if row["rows"] == 0:
        faults.append("no rows")
    if row.get("duplicate_ids"):
        faults.append(f"{row['duplicate_ids']} duplicate case_id value(s)")
    if row.get("unexpected_rows"):
        faults.append(f"expected {expected} rows, found {row['rows']}")
    faults += [
        f"{n} blank value(s) in {name[6:]}"
        for name, n in row.items()
        if name.startswith("blank_") and n
    ]
    if faults:
        raise DataValidationError("case data rejected: " + "; ".join(faults))


def contract(cases: DataFrame, skeleton: DataFrame) -> DataFrame:
    """How the ids of a submission skeleton differ from those of the cases.

    Rows (check, found, sample): both id sets are tagged, brought together by
    one shuffle and counted, so neither is collected.  A sample names the three
    smallest ids.
    """
    tagged = cases.select("case_id", F.lit(1).alias("c"), F.lit(0).alias("s")).unionAll(
        skeleton.select(X.strip(F.col("case_id")), F.lit(0), F.lit(1))
    )
    ids = tagged.groupBy("case_id").agg(F.sum("c").alias("c"), F.sum("s").alias("s"))
    missing, extra = F.col("s") == 0, F.col("c") == 0
    number = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    counted = ids.agg(
        number(F.col("c")).alias("cases"), number(F.col("s")).alias("rows"),
        number(F.greatest(F.col("s") - 1, F.lit(0))).alias("duplicates"),
        number(missing.cast("int")).alias("missing"), number(extra.cast("int")).alias("extra"),
    )
    kind = F.when(missing, "missing").when(extra, "extra")
    first = Window.partitionBy("kind").orderBy("case_id")
    three = ids.select(kind.alias("kind"), "case_id").where(F.col("kind").isNotNull()).withColumn(
        "rank", F.row_number().over(first)
    ).where("rank <= 3")

    def sample(name: str) -> Column:
        ids_of = F.collect_list(F.when(F.col("kind") == name, F.col("case_id")))
        return F.array_join(F.array_sort(ids_of), ",")

    samples = three.agg(sample("missing").alias("m"), sample("extra").alias("e"))
    return counted.selectExpr(
        "stack(5, 'cases', cases, 'rows', rows, 'duplicates', duplicates, 'missing', missing, 'extra', extra) AS (check, found)"
    ).withColumn("sample", F.lit("")).unionAll(
        samples.selectExpr("stack(2, 'missing_sample', m, 'extra_sample', e) AS (check, sample)")
        .select("check", F.lit(None).cast("bigint"), "sample")
    )


def submission_errors(cases: DataFrame, state: DataFrame, limit: int = 10) -> DataFrame:
    """Violations in order, at most ``limit`` and then one line with the rest's number.

    ``cases`` has (case_id, row_index); ``state`` is the latest record per case
    with ``first_seq``.  An empty result means the run is final.
    """
    record = state.select("case_id", "status", "report", "first_seq", F.lit(True).alias("known"))
    both = cases.select("case_id", "row_index", F.lit(True).alias("listed")).join(record, "case_id", "full_outer")
    listed, known = F.col("listed").isNotNull(), F.col("known").isNotNull()
    spans = quoted_spans(F.col("report"))
    message = (
        F.when(~known, F.concat(F.lit("missing: "), "case_id", F.lit(" was never attempted")))
        .when(
            F.col("status") != K.SUCCESS,
            F.concat(F.lit("not succeeded: "), "case_id", F.lit(" has status "), "status"),
        )
        .when(X.is_blank(F.col("report")), F.concat(F.lit("empty report: "), "case_id"))
        .when(spans != "", F.concat(F.lit("bracketed text in report: "), "case_id", F.lit(" "), spans))
    )
    own = Window.partitionBy("case_id")
    d = both.select(
        "case_id", listed.alias("listed"),
        F.when(listed, F.struct(F.col("row_index").cast("bigint").alias("place"), message.alias("message"))).alias("fault"),
        F.when(~listed & (F.col("status") == K.SUCCESS), F.col("first_seq")).alias("stranger"),
        (F.min("first_seq").over(own) < F.max("first_seq").over(own)).alias("repeated"),
    )
    counts = d.agg(
        F.count_if("listed").alias("cases"), F.count_if(F.col("fault.message").isNotNull()).alias("faults"),
        F.count("stranger").alias("strangers"), F.coalesce(F.max(F.col("repeated").cast("int")), F.lit(0)).alias("repeated"),
    )
    # the first messages and the first strangers: a few rows of each task reach the last one
    kind = F.when(F.col("fault.message").isNotNull(), 0).when(F.col("stranger").isNotNull(), 1)
    order = Window.partitionBy("kind").orderBy("place", "case_id")
    first = d.select(
        kind.alias("kind"), F.coalesce("fault.place", "stranger").alias("place"), "case_id", F.col("fault.message").alias("message")
    ).where(F.col("kind").isNotNull()).withColumn("n", F.row_number().over(order)).where(F.col("n") <= max(limit, 5))

    def listing(which: int, column: str, most: int) -> Column:
        rows = F.collect_list(F.when((F.col("kind") == which) & (F.col("n") <= most), F.struct("n", column)))
        return F.transform(F.array_sort(rows), lambda x: x[column])

    shown = first.agg(listing(0, "message", limit).alias("messages"), listing(1, "case_id", 5).alias("ids"))
    one = lambda condition, text: F.when(condition, F.array(text)).otherwise(F.array().cast("array<string>"))
    every = F.concat(
        F.col("messages"),
        one(F.col("cases") == 0, F.lit("no test cases")),
        one(F.col("strangers") > 0, F.concat(F.lit("unexpected case_id(s) in state: "), X.quoted_list(F.col("ids")))),
        one(F.col("repeated") > 0, F.lit("duplicate case_id(s) in state")),
    )
    number = (
        F.col("faults") + (F.col("cases") == 0).cast("int") + (F.col("strangers") > 0).cast("int") + F.col("repeated")
    )
    rest = one(number > limit, F.concat(F.lit("... and "), (number - limit).cast("string"), F.lit(" more issue(s)")))
    single = counts.unionByName(shown, allowMissingColumns=True)
    joined = single.agg(*[F.max(c).alias(c) for c in single.columns])
    return joined.select(F.posexplode(F.concat(F.slice(every, 1, limit), rest)).alias("at", "message")).select(
        (F.col("at") + 1).cast("bigint").alias("rank"), "message"
    )
