"""Benchmark decontamination by spaced-seed hashing.

Texts are compared by words: runs of bytes that are not ASCII blanks or
punctuation, with A-Z lower-cased.  A seed is a fixed mask over consecutive
words that hashes only the places marked 1; words under a 0 may differ.  The
seeds of the test items meet those of every document.  A hit aligns document
and item on one diagonal; the words around it are compared, and the document
is contaminated if some ``overlap`` consecutive places (all places of a shorter
item) agree in at least ``similar`` of them.  With the masks below each such
place, wherever the exchanged words are, holds a hit (a test tries all cases
up to the default overlap and similarity).

Items of fewer than ``strict`` words count where all their words stand in a row,
unchanged; those of up to four words, too short for a mask, meet by a hash of the
whole item.  Null, empty or wordless texts are clean and such items in no
document.  Repeated items and documents are judged each by itself.  All null
item_ids are one item, which ``item_id`` names only where no other is found.
Further columns do not matter.

The items are a stated set against all documents, in blocks of ``BLOCK_WORDS``
words: a block is broadcast to the tasks, each of which joins the seeds of its
documents with it, a slice of text at a time, and is let go before the next one
is made.  Memory is bounded by the block and the slice, on the driver too.
With one block no text is shuffled; with more, the keys of the contaminated
texts are gathered over all blocks and taken off by an anti-join.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.llm.words import LOWER, PUNCTUATION, U, mix, words
from redline.sources.shared import keep

#: Places of a seed that count.  Fixed values.
MASKS = ("11101", "110011", "1101001")
BLOCK_WORDS = 1_000_000  # 24 MB of seeds and words
FILTER_BITS = 22


def _seeds(h: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the marked places from every word on; runs may cross rows."""
    n = len(h) - len(mask) + 1
    out = np.full(max(n, 0), len(mask), U)
    for at, mark in enumerate(mask):
        if mark == "1" and n > 0:
            out = out * U(0x9E3779B97F4A7C15) + h[at:at + n]
    return mix(out)


class Items:
    """A block of test items: their words and, for each mask, their sorted seeds."""

    def __init__(self, ids: list[int], texts: list[str | None], strict: int, overlap: int, similar: float):
        self.ids = pa.array(ids, pa.int64())
        self.strict, self.overlap, self.similar = strict, overlap, similar
        parts, sizes = [np.zeros(0, U)], np.zeros(len(ids), np.int64)
        for w in words(pa.array(texts, pa.large_string()), PUNCTUATION, LOWER):
            sizes[w.first:w.first + w.rows] = np.diff(w.bounds)
            parts.append(w.hash)
        self.words = np.concatenate(parts)
        self.begin = np.concatenate([[0], np.cumsum(sizes)])
        item = np.repeat(np.arange(len(ids)), sizes)
        self.seeds = []
        least = min(map(len, MASKS))
        whole = [("1" * n, sizes == n) for n in range(1, least) if (sizes == n).any()]
        for mask, usable in [*whole, *((m, sizes >= least) for m in MASKS)]:
            n = len(self.words) - len(mask) + 1
            at = np.flatnonzero((item[:n] == item[len(mask) - 1:]) & usable[item[:n]]) if n > 0 else np.zeros(0, int)
            seed = _seeds(self.words, mask)[at]
            order = np.argsort(seed, kind="stable")
            table = np.zeros(1 << FILTER_BITS, bool)
            table[seed >> U(64 - FILTER_BITS)] = True
            self.seeds.append((mask, seed[order], at[order], item[at[order]], table))

    def hits(self, h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
        """``row``, ``item``, first word in the row, places and equal places of every overlap found.

        h: the words of some rows, those of row i from bounds[i] on.
        """
        row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        found = [np.zeros((0, 3), np.int64)]
        for mask, seeds, places, owner, table in self.seeds:
            n = len(h) - len(mask) + 1
            if n <= 0 or not len(seeds):
                continue
            seed = _seeds(h, mask)
            at = np.flatnonzero(table[seed >> U(64 - FILTER_BITS)] & (row[:n] == row[len(mask) - 1:]))
            low, high = np.searchsorted(seeds, seed[at]), np.searchsorted(seeds, seed[at], "right")
            count = high - low
            at, low, count = at[count > 0], low[count > 0], count[count > 0]
            which = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
            found.append(np.stack([np.repeat(row[at], count), owner[which], np.repeat(at, count) - places[which]], 1))
        return self._verify(h, bounds, np.unique(np.concatenate(found), axis=0))

    def _verify(self, h, bounds, triples):
        out = [np.zeros((0, 5), np.int64)]
        for i in range(0, len(triples), 20_000):
            row, item, diagonal = triples[i:i + 20_000].T
            begin, end = self.begin[item], self.begin[item + 1]
            low = np.maximum(begin, bounds[row] - diagonal)  # places of the item that have a word beside them
            high = np.minimum(end, bounds[row + 1] - diagonal)
            size = np.minimum(self.overlap, end - begin)
            for j in np.flatnonzero(high - low >= size):
                same = self.words[low[j]:high[j]] == h[low[j] + diagonal[j]:high[j] + diagonal[j]]
                sums = np.concatenate([[0], np.cumsum(same)])
                equal = sums[size[j]:] - sums[:len(sums) - size[j]]
                best = int(equal.argmax())
                if equal[best] >= (size[j] if end[j] - begin[j] < self.strict else math.ceil(self.similar * size[j])):
                    first = low[j] + best + diagonal[j] - bounds[row[j]]
                    out.append(np.array([[row[j], item[j], first, size[j], equal[best]]], np.int64))
        return np.concatenate(out).T


def blocks(benchmark: DataFrame, strict: int, overlap: int, similar: float) -> Iterator[Items]:
    """The items, one bounded block at a time."""
    ids, texts, held = [], [], 0
    for r in benchmark.where("text IS NOT NULL").select("item_id", "text").toLocalIterator():
        ids.append(r[0])
        texts.append(r[1])
        held += len(r[1]) // 2 + 1
        if held >= BLOCK_WORDS:
            yield Items(ids, texts, strict, overlap, similar)
            ids, texts, held = [], [], 0
    if ids:
        yield Items(ids, texts, strict, overlap, similar)


def overlaps(docs: DataFrame, benchmark: DataFrame, strict: int = 8, overlap: int = 13, similar: float = 0.8) -> DataFrame:
    """``doc_id``, ``item_id``, ``first_word``, ``places``, ``equal``: the best overlap of each diagonal found."""
    id_ = F.col("doc_id").cast("long").alias("doc_id")
    return _found(docs.select(id_, F.col("text").cast("string").alias("text")), benchmark, strict, overlap, similar)


def _found(texts: DataFrame, benchmark: DataFrame, strict: int, overlap: int, similar: float) -> DataFrame:
    """Overlaps of the texts in the second column, beside the first column."""
    spark, key = texts.sparkSession, texts.schema[0]
    schema = T.StructType([key, *(T.StructField(c, T.LongType()) for c in ("item_id", "first_word", "places", "equal"))])
    out, left = spark.createDataFrame([], schema), blocks(benchmark, strict, overlap, similar)
    block = next(left, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(block)

        def find(batches, shared=shared):
            items = shared.value
            for batch in batches:
                for w in words(batch.column(1), PUNCTUATION, LOWER):
                    row, item, *rest = items.hits(w.hash, w.bounds)
                    if len(row):
                        yield pa.RecordBatch.from_arrays(
                            [batch.column(0).take(pa.array(w.first + row)), items.ids.take(pa.array(item)), *map(pa.array, rest)],
                            names=schema.names,
                        )

        found, block = texts.mapInArrow(find, schema), next(left, None)
        if block is None and out.isEmpty():
            return found
        out = out.unionByName(keep(found))
        shared.destroy()
    return out


def report(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Every document with ``contaminated``, ``n_items`` and the smallest ``item_id`` found in it."""
    found = overlaps(docs, benchmark, **options).groupBy("doc_id").agg(
        (F.countDistinct("item_id") + F.max(F.col("item_id").isNull().cast("int"))).alias("n_items"),
        F.min("item_id").alias("item_id"), F.max("equal").alias("most_equal"),
    )
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"))
    return ids.join(found, "doc_id", "left").select(
        "doc_id", F.col("n_items").isNotNull().alias("contaminated"),
        F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("most_equal", F.lit(0)).alias("most_equal"),
    )


def apply(docs: DataFrame, benchmark: DataFrame, strict: int = 8, overlap: int = 13, similar: float = 0.8) -> DataFrame:
    """The clean documents, all columns as they are."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index("text")
    first = list(islice(blocks(benchmark, strict, overlap, similar), 2))
    if not first:
        return docs
    if len(first) > 1:
        key, own = _text_key(F.col("text")), "_text_key"
        while own in docs.columns:
            own += "_"
        texts = docs.where("text IS NOT NULL").select(key.alias(own), F.col("text").cast("string").alias("text"))
        gone = keep(_found(texts, benchmark, strict, overlap, similar).select(own).distinct())
        return docs.withColumn(own, key).join(gone, own, "left_anti").select(*docs.columns)
    shared = spark.sparkContext.broadcast(first[0])

    def clean(batches):
        items = shared.value
        for batch in batches:
            stay = np.ones(batch.num_rows, bool)
            for w in words(batch.column(at), PUNCTUATION, LOWER):
                stay[w.first + items.hits(w.hash, w.bounds)[0]] = False
            yield batch.filter(pa.array(stay))

    return docs.mapInArrow(clean, schema)


def _text_key(text: Column) -> Column:
    """Null for a null text."""
    return F.when(text.isNotNull(), F.sha2(text.cast("string"), 256))
