"""License scans by diagonal voting, in DataFrame functions only.

Words are runs of letters, digits and characters beyond ASCII, A-Z lower-cased.
``PHRASES`` are the base: they count at every place where their words stand
consecutively.  ``NOTICES`` are longer templates that may be changed a little.

1. The hash of every pair of neighbouring words of every text joins the pairs of
   the templates.  A hit at word i of the text and word j of the template votes
   for the diagonal i - j.
2. Votes are added up by text, template and diagonal, together with the words that
   the diagonal lays beside the template.
3. A phrase is verified on its diagonal: all its words have to be equal.
4. Words put in or left out move a notice to a neighbouring diagonal, so each
   diagonal is merged with those at most ``SLACK`` away.  Merged diagonals with
   votes from at least ``VOTES`` of the pairs of the notice are verified on the
   words: a notice is found if at least ``SHARE`` of its words stand at their
   place on one of the diagonals.

Every text also sends one row of its own through the same join and sums, so texts
are read and split once, and what goes through the shuffle is that row and the
votes.  The score of a text is 1 with a phrase, else the largest share of a notice
whose diagonals had the votes, else 0.

Null, empty and wordless texts have no places and no labels.  Rows that repeat a
doc_id are texts of their own and give a row each; rows without doc_id too.
Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.functions.text import bind
from redline.sources.shared import keep

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # a third of the time of extracting the words
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SLACK = 3
VOTES = 0.3
SHARE = 0.7

# fixed values: the phrases of the contract and the opening words of public license notices
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"
            " as published by the free software foundation"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
]


def _pair(a: Column, b: Column) -> Column:
    return F.xxhash64(a, b)


def templates(spark, phrases: list[tuple[str, str]], notices: list[tuple[str, str]]) -> DataFrame:
    """``template``, ``label``, ``words``, ``phrase``: a table as small as the lists."""
    rows = [(i, label, words.split(), i < len(phrases)) for i, (label, words) in enumerate(phrases + notices)]
    short = [words for _, _, words, _ in rows if len(words) < 2]
    if short:
        raise ValueError(f"templates need two words at least: {short}")
    return spark.createDataFrame(rows, "template int, label string, words array<string>, phrase boolean")


def _places(known: DataFrame) -> DataFrame:
    """``pair``, ``template``, ``at``, ``length``: where pairs of words stand; the template -1 is the text itself, see ``hits``."""
    w = F.col("words")
    placed = known.select("template", "words", F.explode(F.sequence(F.lit(0), F.size(w) - 2)).alias("at")).select(
        _pair(F.get(w, F.col("at")), F.get(w, F.col("at") + 1)).alias("pair"), "template", "at", F.size(w).alias("length")
    )
    own = known.sparkSession.range(1).select(
        _own_pair().alias("pair"), F.lit(-1).alias("template"), F.lit(0).alias("at"), F.lit(0).alias("length")
    )
    return placed.unionByName(own)


def _own_pair() -> Column:
    """The hash under which a text joins for itself; a pair of words that shares it has a place, the text has none."""
    return F.xxhash64(F.lit("a text for itself"))


def hits(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``doc_id``, ``key`` of the text, ``template``, ``diagonal``, ``at``, and ``beside``, the words along the template.

    Every text has a row of template -1 with ``n_words`` as well.
    """
    text = F.col("text").cast("string")
    words = F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BREAK), "")

    def pairs(w: Column) -> Column:
        inside = F.transform(w, lambda x, i: _pair(x, F.get(w, i + 1)))
        return F.struct(w.alias("w"), F.concat(F.array(_own_pair()), inside).alias("pairs"))

    split = docs.select(
        F.col("doc_id"), F.xxhash64(text).alias("key"), bind(words, pairs).alias("x")
    ).select("doc_id", "key", "x.w", F.posexplode("x.pairs").alias("i", "pair")).withColumn("i", F.col("i") - 1)
    i, at = F.col("i"), F.col("at")
    diagonal = i - at
    # a case, as an equality of both signs would become a second key of the join
    joined = split.join(F.broadcast(_places(known)), "pair").where(F.when(i < 0, F.col("template") < 0).otherwise(F.col("template") >= 0))
    begin = F.greatest(diagonal, F.lit(0))
    size = F.least(diagonal + F.col("length"), F.size("w")) - begin
    return joined.select(
        "doc_id", "key", "template", "at",
        F.when(i >= 0, diagonal).alias("diagonal"),
        F.when(i >= 0, F.slice("w", begin + 1, size)).alias("beside"),
        F.when(i < 0, F.size("w")).cast("long").alias("n_words"),
    )


def votes(found: DataFrame) -> DataFrame:
    """Hits by text, template and diagonal: ``pairs`` are the places in the template that voted, ``copies`` the rows of the text."""
    return found.groupBy("doc_id", "key", "template", "diagonal", "beside", "n_words").agg(
        F.collect_set("at").alias("pairs"), F.count(F.lit(1)).alias("copies")
    )


def _equal() -> Column:
    """The places in the template at which the text has the same word."""
    first = F.greatest(-F.col("diagonal"), F.lit(0))
    same = F.transform("beside", lambda x, i: F.when(x == F.get("words", first + i), first + i))
    return F.array_compact(same)


def verified(voted: DataFrame, known: DataFrame, slack: int = SLACK, share: float = VOTES) -> DataFrame:
    """``share`` of the words found, of every diagonal whose votes suffice; ``start`` of the phrases, which have to be whole."""
    n = F.size("words")
    equal = voted.where("template >= 0").join(F.broadcast(known), "template").withColumn("equal", _equal())
    phrases = equal.where(F.col("phrase") & (F.size("equal") == n)).select(
        "doc_id", "key", "label", F.lit(True).alias("phrase"), F.col("diagonal").cast("long").alias("start"), F.lit(1.0).alias("share")
    )
    near = Window.partitionBy("doc_id", "key", "template").orderBy("diagonal").rangeBetween(-slack, slack)

    def merged(c: str) -> Column:
        return F.size(F.array_distinct(F.flatten(F.collect_list(c).over(near))))

    notices = equal.where(~F.col("phrase")).select(
        "doc_id", "key", "label", n.alias("n"), merged("pairs").alias("votes"), merged("equal").alias("words_found"),
    ).where(F.col("votes") >= share * (F.col("n") - 1)).select(
        "doc_id", "key", "label", F.lit(False).alias("phrase"), F.lit(None).cast("long").alias("start"),
        (F.col("words_found") / F.col("n")).alias("share"),
    )
    return phrases.unionByName(notices)


def scan(
    docs: DataFrame, phrases: list[tuple[str, str]] = PHRASES, notices: list[tuple[str, str]] = NOTICES,
    slack: int = SLACK, votes_share: float = VOTES, share: float = SHARE,
) -> DataFrame:
    """One row per row: ``doc_id``, ``n_words``, ``n_base``, ``first_word``, ``last_word``, ``base_labels``, ``labels``, ``score``."""
    known = templates(docs.sparkSession, phrases, notices)
    voted = keep(votes(hits(docs, known)))
    own = voted.where("template < 0").select("doc_id", "key", "n_words", "copies")
    base, all_ = F.when(F.col("phrase"), F.col("label")), F.when(F.col("phrase") | (F.col("share") >= share), F.col("label"))
    found = verified(voted, known, slack, votes_share).groupBy(F.col("doc_id").alias("d"), F.col("key").alias("k")).agg(
        F.count("start").alias("n_base"), F.min("start").alias("first_word"), F.max("start").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(base)), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(all_)), ",").alias("labels"), F.max("share").alias("score"),
    )
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k"))
    return own.join(found, same, "left").withColumn(
        "copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))
    ).select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def _sql() -> str:
    """The same for the query, on DuckDB, where every word of a text meets every equal word of a template."""
    rows = [(i, label, words, i < len(PHRASES)) for i, (label, words) in enumerate(PHRASES + NOTICES)]
    values = ", ".join(f"({i}, '{label}', string_split('{words}', ' '), {phrase})" for i, label, words, phrase in rows)
    return f"""
WITH k(template, label, words, phrase) AS (VALUES {values}),
kw AS (SELECT template, unnest(words) AS word, unnest(words[2:] || [NULL]) AS next, generate_subscripts(words, 1) - 1 AS j FROM k),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents
), dw AS (SELECT doc_id, unnest(w) AS word, unnest(w[2:] || [NULL]) AS next, generate_subscripts(w, 1) - 1 AS i FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, template, i - j AS diagonal, j, coalesce(dw.next = kw.next, false) AS pair FROM dw JOIN kw USING (word)),
v AS (
  SELECT doc_id, template, diagonal, list(j) AS equal, coalesce(list(j) FILTER (pair), []) AS pairs FROM m GROUP BY ALL HAVING bool_or(pair)
), f AS (
  SELECT v.doc_id, k.label, true AS phrase, v.diagonal AS start, 1.0::DOUBLE AS share
  FROM v JOIN k USING (template) WHERE k.phrase AND len(v.equal) = len(k.words)
  UNION ALL
  SELECT doc_id, label, false, NULL, n_equal / n::DOUBLE FROM (
    SELECT a.doc_id, a.template, a.diagonal, k.label, len(k.words) AS n, len(list_distinct(flatten(list(b.equal)))) AS n_equal,
      len(list_distinct(flatten(list(b.pairs)))) AS votes
    FROM v a JOIN k USING (template)
    JOIN v b ON a.doc_id = b.doc_id AND a.template = b.template AND b.diagonal BETWEEN a.diagonal - {SLACK} AND a.diagonal + {SLACK}
    WHERE NOT k.phrase GROUP BY ALL
  ) WHERE votes >= {VOTES} * (n - 1)
), g AS (
  SELECT doc_id, count(start) AS n_base, min(start) AS first_word, max(start) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (phrase OR share >= {SHARE}) AS labels, max(share) AS score
  FROM f GROUP BY 1
)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0) AS score
FROM d LEFT JOIN g USING (doc_id)
"""


SQL = _sql()
