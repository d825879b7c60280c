"""Near-duplicate lines by a deletion-neighbourhood join, in DataFrame functions only.

A line is a run between newlines, compared by its words (runs without space,
tab, carriage return, form feed or vertical tab).  Two lines are alike if their
words are equal or, where both have at least ``min_words``, if one insertion,
deletion or substitution of a word makes them equal.  A line goes if a line
alike stands earlier (smaller doc_id, or same document and smaller number), be
that one kept or not; all lines are judged on the input.  Lines without words
always stay.

Steps: equal lines meet by two hashes and keep their first place.  One edit
leaves the first or the last half of the longer line intact, so only lines that
share such a half with another line emit their variants, each the other half
with one word (or none) left out.  Lines with the same variant, and for
substitutions the same place left out, are alike; the earliest of each variant
is an aggregate, so neither a hot half nor a hot variant lists pairs.  The
earliest candidate of a line is verified on the words themselves.

Null or empty texts have no lines.  Rows with null doc_id take no part; equal rows
are one document and give equal results.  Rows that share a doc_id but not the text
are documents of their own, in the order of a hash of their texts (``text_key``).
Only doc_id and text are read, further columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.functions.text import bind
from redline.sources.shared import keep, keep_narrow

BLANK = "[ \\t\\x0B\\f\\r]+"
ROW = ["doc_id", "text_key"]
PLACE = [*ROW, "line_no"]


def _has_words(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\x0b\f\r")) != ""


def _words(line: Column) -> Column:
    return F.filter(F.split(line, BLANK), lambda w: w != "")


def _lines(docs: DataFrame) -> DataFrame:
    return (
        docs.where(F.col("doc_id").isNotNull())
        .select(*ROW, F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
        .where(_has_words(F.col("line")))  # cheaper than splitting a line twice, as a filter on its words would
        .select(*PLACE, _words(F.col("line")).alias("w"))
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def _first_places(docs: DataFrame) -> DataFrame:
    """One row per different line: its first place, size and the hashes of its halves."""
    n = F.size("w")
    short, long = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    longer = F.ceil((n + 1) / 2).cast("int")
    w = F.col("w")
    lines = _lines(docs).select(
        *PLACE, n.alias("n"),
        F.xxhash64("w").alias("h1"), F.xxhash64(F.lit(1), "w").alias("h2"),
        F.xxhash64(F.slice(w, 1, short)).alias("p1"), F.xxhash64(F.slice(w, 1, long)).alias("p2"),
        F.xxhash64(F.slice(w, n - long + 1, long)).alias("s1"),
        F.when(longer <= n, F.xxhash64(F.slice(w, F.greatest(n - longer + 1, F.lit(1)), longer))).alias("s2"),
    )
    return (
        lines.groupBy("h1", "h2", "n", "p1", "p2", "s1", "s2")
        .agg(F.min(F.struct(*PLACE)).alias("at")).select("at.*", "n", "p1", "p2", "s1", "s2")
    )


def _live(first: DataFrame, min_words: int) -> DataFrame:
    """Lines that share a half (``side``, ``m`` words) with a different line."""
    n = F.col("n")
    short, long = F.floor(n / 2).cast("int"), F.ceil(n / 2).cast("int")
    longer = F.ceil((n + 1) / 2).cast("int")
    even = n % 2 == 0

    def half(side: int, m: Column, h: str) -> Column:
        return F.struct(F.lit(side).alias("side"), m.alias("m"), F.col(h).alias("half"))

    halves = F.array_compact(F.array(
        half(0, short, "p1"), F.when(~even, half(0, long, "p2")),
        half(1, long, "s1"), F.when(even, half(1, longer, "s2")),
    ))
    rows = first.where(n >= min_words).select(
        *PLACE, "n", F.explode(halves).alias("x")
    ).select(*PLACE, "n", "x.*")
    # stored, so that Spark sees both sizes and splits a hot half; so is the table of earliest variants below
    shared = keep(rows.groupBy("side", "m", "half").count().where("count > 1").drop("count"))
    return rows.join(shared, ["side", "m", "half"], "left_semi")


def _without_each(words: Column, seed: int) -> Column:
    """Hashes of a word array: of all words first, then of those left when the first, second, ... word is left out.

    A hash is the XOR over words of a hash of word and place.  A word left out moves the later ones by one place,
    so ``changes`` (what moving a word does) of the words before it and the moved total give each hash.  The sums
    before a word are kept for every ``step``-th word: the cost is n times its root, and no array is copied per word.
    """
    zero = F.lit(0).cast("long")

    def total(values: Column) -> Column:
        return F.aggregate(values, zero, lambda a, x: a.bitwiseXOR(x))

    def at(word: Column, place: Column) -> Column:
        return F.xxhash64(F.lit(seed), word, place)

    def hashes(places: Column, changes: Column, sums: Column, moved: Column, step: Column) -> Column:
        def left(x: Column, i: Column) -> Column:
            before = total(F.slice(changes, i - i % step + 1, i % step))
            return moved.bitwiseXOR(F.element_at(sums, (i / step).cast("int") + 1)).bitwiseXOR(before).bitwiseXOR(x["moved"])

        return F.concat(F.array(moved.bitwiseXOR(total(changes))), F.transform(places, left))

    def sums_of(changes: Column, step: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), (F.size(changes) / step).cast("int")), lambda k: total(F.slice(changes, k * step + 1, step))
        )
        return bind(runs, lambda r: F.transform(r, lambda x, k: total(F.slice(r, 1, k))))

    def with_step(places: Column, step: Column) -> Column:
        return bind(
            F.transform(places, lambda x: x["stay"].bitwiseXOR(x["moved"])),
            lambda changes: bind(sums_of(changes, step), lambda sums: bind(
                total(F.transform(places, lambda x: x["moved"])), lambda moved: hashes(places, changes, sums, moved, step)
            )),
        )

    return bind(
        F.transform(words, lambda w, i: F.struct(at(w, i).alias("stay"), at(w, i - 1).alias("moved"))),
        lambda places: bind(
            F.greatest(F.ceil(F.sqrt(F.size(words))), F.lit(1)).cast("int"), lambda step: with_step(places, step)
        ),
    )


def _variants(live: DataFrame) -> DataFrame:
    """``key``, ``key2`` of each variant of a live line; ``w`` are its words."""
    rest = F.when(F.col("side") == 0, F.slice("w", F.col("m") + 1, F.greatest(F.col("n") - F.col("m"), F.lit(0)))).otherwise(
        F.slice("w", 1, F.greatest(F.col("n") - F.col("m"), F.lit(0)))
    )
    both = bind(rest, lambda r: F.zip_with(
        _without_each(r, 1), _without_each(r, 2), lambda x, y: F.struct(x.alias("v1"), y.alias("v2"))
    ))
    h = live.select(*PLACE, "side", "m", "half", "n", F.posexplode(both).alias("i", "v")).select(
        *PLACE, "side", "m", "half", "n", "i", "v.v1", "v.v2"
    )
    # i = 0: the whole line, may equal a longer one with a word left out; else a word left out, or exchanged at i
    kinds = F.when(F.col("i") == 0, F.array(F.struct(F.col("n").alias("size"), F.lit(0).alias("place")))).otherwise(
        F.array(F.struct((F.col("n") - 1).alias("size"), F.lit(0).alias("place")),
                F.struct(F.col("n").alias("size"), F.col("i").alias("place")))
    )
    return h.select(*PLACE, "side", "m", "half", "i", "v1", "v2", F.explode(kinds).alias("k")).select(
        *PLACE,
        F.xxhash64("side", "m", "half", "v1", "k.size", "k.place").alias("key"),
        F.hash("m", "half", "v2", "k.size", "k.place").alias("key2"),
        (F.col("i") == 0).alias("whole"), (F.col("k.place") > 0).alias("exchanged"),
    )


def _at_most_one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays differ by one word edit at most."""

    def common(x: Column, y: Column) -> Column:
        miss = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), F.lit(False))
        return F.when(miss == 0, F.greatest(F.size(x), F.size(y))).otherwise(miss - 1)

    most = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= most - 1)


def kept_lines(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """``doc_id``, ``text_key``, ``line_no``: the places of lines with words that stay, and ``n_near``.

    A row with null line_no counts in ``n_near`` the different lines of the
    document that went for an earlier line alike but not equal.
    """
    docs = _keyed(docs)
    first = keep(_first_places(docs))
    live = keep(_live(first, min_words))
    wanted = live.groupBy(*ROW).agg(F.collect_set("line_no").alias("wanted"))
    words = keep(
        docs.join(wanted, ROW)
        .select(*ROW, F.explode(bind(F.split("text", "\n", -1), lambda lines: F.transform(
            "wanted", lambda i: F.struct(i.alias("line_no"), F.element_at(lines, i + 1).alias("line"))
        ))).alias("x"))
        .select(*ROW, "x.line_no", _words(F.col("x.line")).alias("w"))
        .dropDuplicates(PLACE)
    )
    variants = _variants(live.join(words, PLACE))
    # a whole line is alike to lines with a word more, those with a word exchanged at one place are alike to each other
    place = F.struct(*PLACE)
    earliest = keep(variants.groupBy("key", "key2").agg(
        F.min(F.when(F.col("whole"), place)).alias("whole_at"), F.min(F.when(~F.col("whole"), place)).alias("other_at"),
        F.count(F.lit(1)).alias("c"),
    ).where("c > 1").drop("c"))
    pairs = (
        variants.join(earliest, ["key", "key2"])
        .withColumn("before", F.when(F.col("whole") | F.col("exchanged"), F.col("other_at")).otherwise(F.col("whole_at")))
        .where(F.struct(*PLACE) > F.col("before"))
        .groupBy(*PLACE).agg(F.min("before").alias("before"))
        .select(*PLACE, *(F.col(f"before.{c}").alias(f"to_{c}") for c in PLACE))
    )
    other = words.select(*(F.col(c).alias(f"to_{c}") for c in PLACE), F.col("w").alias("w2"))
    near = (
        pairs.join(words, PLACE).join(other, [f"to_{c}" for c in PLACE])
        .where(_at_most_one_edit(F.col("w"), F.col("w2"))).select(*PLACE)
    )
    near = keep_narrow(near)
    stay = first.select(*PLACE).join(near, PLACE, "left_anti")
    return stay.select(*PLACE, F.lit(0).alias("n_near")).unionByName(
        near.groupBy(*ROW).agg(F.count(F.lit(1)).cast("int").alias("n_near"))
        .select(*ROW, F.lit(None).cast("int").alias("line_no"), "n_near")
    )


def report(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """Per document: lines with words, how many went (``n_near`` of them for a line not equal), who stayed.

    ``kept_lines`` lists the numbers of the lines that stayed, joined by commas.
    """
    kept = kept_lines(docs, min_words).groupBy(*ROW).agg(
        F.array_sort(F.collect_list("line_no")).alias("kept"), F.sum("n_near").alias("n_near")
    )
    n = F.size(F.filter(F.split("text", "\n", -1), _has_words))
    sizes = _keyed(docs).where(F.col("doc_id").isNotNull()).select(
        *ROW, F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines")
    )
    none = F.array().cast("array<int>")
    return sizes.join(kept, ROW, "left").select(
        "doc_id", "n_lines",
        (F.col("n_lines") - F.size(F.coalesce("kept", none))).alias("n_removed"),
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.array_join(F.coalesce("kept", none), ",").alias("kept_lines"),
    )


def apply(docs: DataFrame, min_words: int = 8) -> DataFrame:
    """The documents without the lines that go; all columns stay.

    A document of which no line with words is left goes too, one that had none stays.
    """
    name, key = "kept_lines", "text_key"
    while name in docs.columns:
        name += "_"
    while key in docs.columns:
        key += "_"
    kept = kept_lines(docs, min_words).where("line_no IS NOT NULL").groupBy(*ROW).agg(
        F.collect_list("line_no").alias(name)
    ).withColumnRenamed("text_key", key)
    lines = F.split("text", "\n", -1)
    blank = F.col("text").isNull() | (F.size(F.filter(lines, _has_words)) == 0) | F.col("doc_id").isNull()

    def rest_of(parts: Column) -> Column:
        empty = F.filter(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: ~_has_words(F.element_at(parts, i + 1)))
        stay = F.array_sort(F.concat(F.array_distinct(name), empty))
        return F.array_join(F.transform(stay, lambda i: F.element_at(parts, i + 1)), "\n")

    everything = F.size(name) == F.size(lines)
    return (
        docs.withColumn(key, F.xxhash64("text")).join(kept, ["doc_id", key], "left").where(F.col(name).isNotNull() | blank)
        .withColumn("text", F.when(blank | everything, F.col("text")).otherwise(bind(lines, rest_of))).select(*docs.columns)
    )


#: The same for the query, on DuckDB; it lists all variants of all lines.
SQL = """
WITH lines AS (
  SELECT doc_id, generate_subscripts(l, 1) - 1 AS line_no, unnest(l) AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL)
), worded AS (
  SELECT doc_id, line_no, list_filter(regexp_split_to_array(line, '[ \\t\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM lines
), w AS (
  SELECT doc_id, line_no, w, len(w) AS n, doc_id * 10000000 + line_no AS pos FROM worded WHERE len(w) > 0
), firsts AS (
  SELECT w, n, min(pos) AS pos FROM w GROUP BY w, n
), places AS (
  SELECT w, n, pos, unnest(range(0, n + 1)) AS i FROM firsts WHERE n >= 8
), left_out AS (
  SELECT n, pos, i, CASE WHEN i = 0 THEN w ELSE w[1:i - 1] || w[i + 1:] END AS v FROM places
), keyed AS (
  SELECT pos, CASE WHEN i = 0 THEN n ELSE n - 1 END AS size, 0 AS place, i = 0 AS whole, v FROM left_out
  UNION ALL SELECT pos, n, i, false, v FROM left_out WHERE i > 0
), grouped AS (
  SELECT size, place, v, min(pos) FILTER (whole) AS whole_pos, min(pos) FILTER (NOT whole) AS other_pos
  FROM keyed GROUP BY size, place, v HAVING count(*) > 1
), twins AS (
  SELECT DISTINCT k.pos FROM keyed k JOIN grouped g ON k.size = g.size AND k.place = g.place AND k.v = g.v
  WHERE CASE WHEN k.whole OR k.place > 0 THEN other_pos ELSE whole_pos END < k.pos
), stay AS (
  SELECT pos FROM firsts WHERE pos NOT IN (SELECT pos FROM twins)
), kept AS (
  SELECT pos // 10000000 AS doc_id, string_agg(CAST(pos % 10000000 AS VARCHAR), ',' ORDER BY pos) AS kept_lines, count(*) AS n_kept
  FROM stay GROUP BY 1
), near AS (SELECT pos // 10000000 AS doc_id, count(*) AS n_near FROM twins GROUP BY 1),
sizes AS (SELECT doc_id, count(*) AS n_lines FROM w GROUP BY 1)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_lines, 0) - coalesce(n_kept, 0) AS n_removed,
  coalesce(n_near, 0) AS n_near, coalesce(kept_lines, '') AS kept_lines
FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN near USING (doc_id)
WHERE d.doc_id IS NOT NULL
"""
