"""Importance resampling of documents towards a target, by hashed n-gram counts.

Features of a text are its runs of 1 to ``N`` words (A-Z lower-cased; a word is a
run of letters, digits and bytes beyond ASCII), joined by one space, repeats
counted.  A feature falls into the bucket of its unsigned CRC-32 modulo
``BUCKETS``.  All documents hold S features, s in a bucket; the target texts hold
T and t.  The gain of a bucket is floor(1000 ln((t+1)(S+B) / ((s+1)(T+B)))), the
weight of a document the floored mean gain of its features.  A Gumbel number drawn
from a hash of doc_id is added, so the highest scores are a sample without
replacement in proportion to exp(weight / 1000).

1. Every task adds up its buckets in an array; only the sums are shuffled.
2. Weights are scored in arrays: gains by bucket, summed per document.
3. The cutoff is bracketed by a quantile sketch.  Exact counts outside the bracket
   say whether the cutoff lies in it; if not, it is widened and counted again.
4. Only the bracket is sorted, over ranges, to find the last row that is drawn.

The gains are an array of fixed size and go to all tasks.  CRC-32 is linear, so
the value of two words joined comes from those of the words and the length of the
second, without reading the bytes again.

Null, empty or wordless texts have no features and weight 0.  Documents of fewer
than ``least`` words and rows without doc_id are never drawn and do not count for
the share; rows without doc_id have no score.  Rows that repeat a doc_id are
documents of their own; ties go to the smaller doc_id, then to more features.
Only doc_id and text are read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.llm.words import LOWER, PUNCTUATION, words
from redline.sources.shared import keep

BUCKETS = 10_000
N = 2
_SHORT = 32  # bytes of a word up to which its CRC is taken in arrays

_TABLE = np.arange(256, dtype=np.uint32)
for _ in range(8):  # the byte table of the reflected polynomial of CRC-32
    _TABLE = np.where(_TABLE & 1, (_TABLE >> 1) ^ np.uint32(0xEDB88320), _TABLE >> 1)
_shifts: dict[int, np.ndarray] = {}


def word_crcs(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each range of bytes."""
    size = end - start
    crc = np.full(len(start), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(size <= _SHORT)
    for k in range(_SHORT):
        some = some[size[some] > k]
        if not len(some):
            break
        c = crc[some]
        crc[some] = _TABLE[(c ^ data[start[some] + k]) & 0xFF] ^ (c >> 8)
    crc ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(size > _SHORT):
        crc[i] = zlib.crc32(data[start[i]:end[i]].tobytes())
    return crc


def _shift(n: int) -> np.ndarray:
    """Tables by which ``n`` bytes of zeros act on the four bytes of a CRC; the powers of two are kept."""
    if n not in _shifts:
        if n == 1:
            values = np.arange(256, dtype=np.uint32)
            made = [_TABLE[values]] + [values << np.uint32(8 * (k - 1)) for k in (1, 2, 3)]
        else:
            half = 1 << (n - 1).bit_length() - 1
            made = [_through(_shift(n - half), x) for x in _shift(half)]
        if len(_shifts) > 256:
            _shifts.clear()
        _shifts[n] = np.stack(made)
    return _shifts[n]


def _through(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 0xFF] ^ tables[1][crc >> 8 & 0xFF] ^ tables[2][crc >> 16 & 0xFF] ^ tables[3][crc >> 24]


def joined(first: np.ndarray, second: np.ndarray, size: np.ndarray) -> np.ndarray:
    """CRC-32 of the texts of ``first`` and ``second`` in a row; ``size``: bytes of the second."""
    out = second.copy()
    order = np.argsort(size, kind="stable")
    lengths, at = np.unique(size[order], return_index=True)
    for n, some in zip(lengths.tolist(), np.split(order, at[1:])):
        out[some] ^= _through(_shift(n), first[some]) if n else first[some]
    return out


_SPACE = np.uint32(zlib.crc32(b" "))


def features(texts: pa.Array, n: int = N, buckets: int = BUCKETS) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Per slice: rows, words of each row, the row and the bucket of every feature."""
    for w in words(texts, PUNCTUATION, LOWER, hashed=False):
        size = w.end - w.start
        crc = word_crcs(LOWER[w.data], w.start, w.end)
        rows, found, run = [w.row], [crc % buckets], crc
        for k in range(1, n):
            run = joined(joined(run[:-1], np.full(max(len(run) - 1, 0), _SPACE), np.ones(max(len(run) - 1, 0), np.int64)), crc[k:], size[k:])
            whole = w.row[: len(run)] == w.row[k:]
            rows.append(w.row[: len(run)][whole])
            found.append(run[whole] % buckets)
        yield w.rows, np.diff(w.bounds), np.concatenate(rows), np.concatenate(found).astype(np.int64)


def bucket_counts(texts: DataFrame, n: int = N, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of the ``text`` column fall into each bucket; the result has ``buckets`` numbers whatever the table."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in features(batch.column(0), n, buckets):
                total += np.bincount(found, minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "c"])

    sums = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, c long")
    out = np.zeros(buckets, np.int64)
    for bucket, c in sums.groupBy("bucket").agg(F.sum("c").alias("c")).collect():
        out[bucket] = c
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln of the smoothed ratio of shares) of every bucket."""
    s, t, b = source.astype(float), target.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + b) / ((s + 1) * (t.sum() + b)))).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, n: int = N) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight`` of every row."""

    def score(batches):
        for batch in batches:
            first = 0
            for rows, n_words, row, found in features(batch.column(1), n, len(gain)):
                count = np.bincount(row, minlength=rows)
                # whole numbers below 2^53 add up exactly
                total = np.bincount(row, gain[found], rows).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, rows), pa.array(n_words, pa.int64()), pa.array(count, pa.int64()),
                    pa.array(total // np.maximum(count, 1), pa.int64()),
                ], names=["doc_id", "n_words", "n_features", "weight"])
                first += rows

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        score, "doc_id long, n_words long, n_features long, weight long"
    )


def gumbel(doc_id: Column, seed: int = 7) -> Column:
    """floor(-1000 ln(-ln u)) for u drawn from the SHA-256 of seed and doc_id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))


def scored(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, seed: int = 7) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_features``, ``weight``, ``score`` of every row."""
    gain = gains(bucket_counts(docs, n, buckets), bucket_counts(target, n, buckets))
    return weigh(docs, gain, n).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc("doc_id"), F.desc("n_features"), F.desc("weight")]


def ranked(rows: DataFrame, k: int | None = None) -> DataFrame:
    """``rank`` from 1 in the order of the draw, by a sort over ranges; the first ``k`` rows, if given."""

    def place(batches):
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            i = np.arange(n + 1, n + 1 + batch.num_rows)
            n += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(np.full(batch.num_rows, part, np.int32)), pa.array(i)], names=[*batch.schema.names, "part", "i"]
            )

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = keep(rows.repartitionByRange(*_order()).sortWithinPartitions(*_order()).mapInArrow(place, f"{schema}, part int, i long"))
    # one row for each range
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("c"))
    before = keep(sizes.select("part", F.coalesce(F.sum("c").over(
        Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")))
    out = placed.join(before, "part").withColumn("rank", F.col("before") + F.col("i")).drop("part", "i", "before")
    return out if k is None else out.where(F.col("rank") <= k)


def cutoff(rows: DataFrame, k: int, accuracy: int = 1000) -> tuple:
    """(score, doc_id, n_features, weight) of the k-th row of the draw, 1 <= k <= rows.

    ``accuracy`` is the relative one of the sketch; a bracket of twice its error
    on either side of the wanted quantile nearly always holds the row.
    """
    n = rows.count()
    half = 2 / accuracy
    while True:
        # from above, as the draw takes the highest scores
        low, high = max(0.0, 1 - k / n - half), min(1.0, 1 - k / n + half)
        least, most = rows.agg(F.percentile_approx("score", F.array(F.lit(low), F.lit(high)), accuracy)).first()[0]
        if low == 0:
            least = None  # open below
        if high == 1:
            most = None
        above = rows.where(F.col("score") > most).count() if most is not None else 0
        bracket = rows.where((F.col("score") >= least if least is not None else F.lit(True))
                             & (F.col("score") <= most if most is not None else F.lit(True)))
        if above < k <= above + bracket.count():
            break
        half *= 4  # reaches the whole table in the end
    last = ranked(bracket).where(F.col("rank") == k - above).first()
    return last.score, last.doc_id, last.n_features, last.weight


def draw(docs: DataFrame, target: DataFrame, percent: int = 25, least: int = 20, **options) -> tuple[DataFrame, int]:
    """All rows with their scores and ``drawn``, stored; and floor(percent * N / 100) of the N documents with enough words.

    Rows equal to the last one in all that orders them are marked with it.
    """
    rows = keep(scored(docs, target, **options))
    able = (F.col("n_words") >= least) & F.col("doc_id").isNotNull()
    k = percent * rows.where(able).count() // 100
    if not k:
        return rows.withColumn("drawn", F.lit(False)), 0
    score, doc_id, n_features, weight = cutoff(rows.where(able), k)
    s, d, f, w = (F.col(c) for c in ("score", "doc_id", "n_features", "weight"))
    tied = (s == score) & (d == doc_id)
    reached = (s > score) | (s == score) & (d < doc_id) | tied & (f > n_features) | tied & (f == n_features) & (w >= weight)
    return rows.withColumn("drawn", F.coalesce(able & reached, F.lit(False))), k


def report(docs: DataFrame, target: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``n_features``, ``weight``, ``score`` and ``rank`` of every row, null where it was not drawn."""
    rows, k = draw(docs, target, **options)
    columns = ["doc_id", "n_features", "weight", "score"]
    drawn = ranked(rows.where("drawn").select(columns))
    return drawn.select(*columns, F.when(F.col("rank") <= k, F.col("rank")).alias("rank")).unionByName(
        rows.where("NOT drawn").select(*columns, F.lit(None).cast("long").alias("rank"))
    )


#: The same for the query, on DuckDB.
SQL = """
WITH w AS (
  SELECT doc_id, len(w) AS n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents)
), g AS (
  SELECT w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) AS f FROM (
    SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark)
), d AS (SELECT doc_id, unnest(f) AS x FROM w), b AS (SELECT unnest(f) AS x FROM g),
xs AS (SELECT x, hex(encode(x)) AS s FROM (SELECT x FROM d UNION SELECT x FROM b)),
bytes AS (
  SELECT x, list_transform(range(0, length(s) // 2), lambda i: CAST(
    16 * (instr('0123456789ABCDEF', s[2 * i + 1]) - 1) + instr('0123456789ABCDEF', s[2 * i + 2]) - 1 AS BIGINT)) AS v FROM xs
), table_ AS (
  SELECT list(list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i) ORDER BY i) AS crc
  FROM (SELECT unnest(range(0, 256)) AS i)
), bucket AS (
  SELECT x, xor(list_reduce(v, lambda c, y: xor(c // 256, crc[xor(c % 256, y) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 10000 AS bucket
  FROM bytes, table_
), s AS (SELECT bucket, count(*) AS s FROM d JOIN bucket USING (x) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM b JOIN bucket USING (x) GROUP BY 1),
sizes AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS ss, (SELECT coalesce(sum(t), 0) FROM t) AS tt),
gain AS (
  SELECT bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) + 1 AS DOUBLE) * CAST(ss + 10000 AS DOUBLE))
    / (CAST(coalesce(s, 0) + 1 AS DOUBLE) * CAST(tt + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM s FULL JOIN t USING (bucket), sizes
), weights AS (
  SELECT doc_id, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM d JOIN bucket USING (x) JOIN gain USING (bucket) GROUP BY 1
), h AS (
  SELECT doc_id, n_words, len(f) AS n_features, coalesce(weight, 0) AS weight,
    list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', sha256('7:' || doc_id)[i]) - 1 AS BIGINT)),
      lambda a, x: 16 * a + x) AS h
  FROM w LEFT JOIN weights USING (doc_id)
), scored AS (
  SELECT *, weight + CAST(floor(-1000 * ln(-ln((CAST(h AS DOUBLE) + 0.5) / 4294967296.0::DOUBLE))) AS BIGINT) AS score FROM h
), ranked AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_words >= 20
), k AS (SELECT 25 * count(*) // 100 AS k FROM ranked)
SELECT s.doc_id, CAST(n_features AS BIGINT) AS n_features, weight, score, CASE WHEN rank <= k THEN rank END AS rank
FROM scored s LEFT JOIN ranked USING (doc_id), k
"""
