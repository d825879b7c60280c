"""Registered queries of the corpus operators and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm import (
    convtrie, decontaminate, idfiles, langid, licensescan, linededup, neardup, pieces, resample, substrings, tokencounts, topk, urlfilter,
)
from redline.sources.shared import keep, new_folder, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op2_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return idfiles.round_trip(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


@query
def op10_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every whole text as count and checksum, and whether they decode to it."""
    docs = table(spark, sf_dir, "documents")
    return pieces.encode(docs, public_tokenizers.path("piece_bpe_32k.model")).drop("ids")


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(table(spark, sf_dir, "documents"))


SQL["op6_line_dedup"] = linededup.SQL


@query
def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.report(table(spark, sf_dir, "documents"))


@query
def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.report(table(spark, sf_dir, "documents"), percent=85)


@query
def op3_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.report(table(spark, sf_dir, "documents"))


@query
def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return topk.top_k(rows.where("vec_id % 50 = 0"), rows, 5)


SQL["op5_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, d.vec_id,
    CAST(list_sum(list_transform(range(1, 1 + len(q.v)), lambda i: q.v[i] * d.v[i])) AS BIGINT) AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op4_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    return urlfilter.verdicts(table(spark, sf_dir, "pages"), rules)


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in, those labelled toxic go, those of low quality are counted anew with their end id."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    counted = keep(tokencounts.measure(docs, public_tokenizers.path("word_bpe_49k.json"), "word_bpe_49k/1"))
    marks = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    marked = counted.join(marks, "doc_id")
    toxic = marked.where("toxic = 1").drop("toxic", "quality")
    poor = marked.where("quality = 0 AND (toxic IS NULL OR toxic <> 1)").drop("toxic", "quality")
    again = poor.withColumn("version", F.lit("word_bpe_49k/2")).withColumn("n_tokens", F.col("n_tokens") + 1)
    totals = tokencounts.Rollup(spark, new_folder(spark, "rollup"))
    totals.commit("load", tokencounts.signed_rows(counted, 1))
    totals.commit("purge", tokencounts.signed_rows(toxic, -1))
    totals.commit("load", tokencounts.signed_rows(counted, 1))  # a repeated delivery changes nothing
    totals.commit("version 2", tokencounts.revision(poor, again))
    return totals.totals()


@query
def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licensescan.scan(table(spark, sf_dir, "documents"))


SQL["op11_licenses"] = licensescan.SQL


@query
def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op12_resample"] = resample.SQL


@query
def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return convtrie.trie(*convtrie.rebuilt(table(spark, sf_dir, "conversations")))


SQL["op13_prefix_trie"] = convtrie.SQL


_WORDS = "'[^\\x20\\x09-\\x0D]+'"

SQL["op3_substrings"] = f"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, len(w) AS n FROM w),
h AS (
  SELECT *, doc_id * 10000000 + j AS pos, CASE WHEN j <= n - 19 THEN string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING) END AS x FROM t
), f AS (SELECT x, min(pos) AS before FROM h WHERE x IS NOT NULL GROUP BY x),
r AS (SELECT h.*, coalesce(f.before < h.pos, false) AS repeated FROM h LEFT JOIN f ON h.x = f.x),
g AS (
  SELECT *, bool_or(repeated) OVER (PARTITION BY doc_id ORDER BY j ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM r
), k AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed,
    string_agg(word, ' ' ORDER BY j) FILTER (NOT gone) AS kept FROM g GROUP BY 1
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM documents d LEFT JOIN k USING (doc_id)
"""

SQL["op8_neardup"] = f"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {_WORDS}) AS w
  FROM documents WHERE text IS NOT NULL
), t AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, len(w) AS n FROM w),
h AS (
  SELECT doc_id, j, n, string_agg(word, ' ') OVER (
    PARTITION BY doc_id ORDER BY j ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS s FROM t
), sh AS (SELECT DISTINCT doc_id, s FROM h WHERE j <= greatest(n - 4, 1)),
sizes AS (SELECT doc_id, count(*) AS c FROM sh GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (
  SELECT p.a, p.b FROM p JOIN sizes x ON x.doc_id = p.a JOIN sizes y ON y.doc_id = p.b WHERE 100 * k >= 85 * (x.c + y.c - k)
), links AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
c AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(s.c, 0) AS n_shingles, component_id, component_id = doc_id AS kept FROM c LEFT JOIN sizes s USING (doc_id)
"""

_LETTERS = "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL["op9_decontaminate"] = f"""
WITH dw AS (SELECT doc_id, regexp_extract_all({_LOWER.format('text')}, {_LETTERS}) AS w FROM documents WHERE text IS NOT NULL),
d AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS j, len(w) AS n FROM dw),
bw AS (SELECT item_id, regexp_extract_all({_LOWER.format('text')}, {_LETTERS}) AS w FROM benchmark WHERE text IS NOT NULL),
b AS (SELECT item_id, unnest(w) AS word, generate_subscripts(w, 1) AS t, len(w) AS l FROM bw),
m AS (
  SELECT doc_id, item_id, j - t AS diagonal, t, l, least(13, l) AS size, least(l, n - (j - t)) - least(13, l) + 1 AS last,
    greatest(1, 1 - (j - t)) AS low
  FROM d JOIN b ON d.word = b.word
), c AS (
  SELECT *, count(*) OVER (
    PARTITION BY doc_id, item_id, diagonal ORDER BY t RANGE BETWEEN CURRENT ROW AND (size - 1) FOLLOWING) AS here
  FROM m WHERE last >= low
), best AS (
  SELECT doc_id, item_id, diagonal, any_value(CASE WHEN l < 8 THEN size ELSE (4 * size + 4) // 5 END) AS needed,
    greatest(coalesce(max(here) FILTER (t <= last), 0), count(*) FILTER (t >= last)) AS same
  FROM c GROUP BY ALL
), f AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, min(item_id) AS item_id, max(same) AS most_equal
  FROM best WHERE same >= needed GROUP BY 1
)
SELECT doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0) AS n_items, item_id, coalesce(most_equal, 0) AS most_equal
FROM documents LEFT JOIN f USING (doc_id)
"""
