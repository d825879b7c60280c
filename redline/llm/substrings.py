"""Repeated passages by prefix-partitioned suffix trees.

Words are runs of bytes without ASCII blanks, unchanged.  A window of ``WINDOW``
words is a repeat if its words also start earlier: in a document with a smaller
doc_id, or earlier in the same one.  Every word that a repeat covers goes.
Windows are judged on the input, not on what is left.

1. Documents with the same words as an earlier one go as a whole if they hold a window.
2. Suffixes are sampled: each window picks the ``PREFIX`` words in it with the
   least hash, so equal windows pick the same place and only one suffix in eight
   or so is needed.  A suffix whose prefix stands nowhere else is a leaf at the
   root and falls out; only counts of prefixes are shuffled for that.
3. The others carry the words around them to the group of their prefix.  Each task
   takes as many groups as fit into memory and builds their subtrees: suffixes
   are sorted, their common prefixes give the internal nodes of each depth.  A
   second tree of the words before the place, read backwards, tells apart where
   an occurrence extends to the left, so that node of depth ``WINDOW - o`` and left
   node of depth ``o`` together are one repeated window.  All its suffixes but the
   first by (doc_id, place) are marked.
4. A prefix with more than ``GROUP`` suffixes is lengthened to the whole window.
   Its nodes then need no tree: the first occurrence is a minimum, aggregated
   before the shuffle, so a passage in a third of all documents loads no task.

Words are compared by 40 bits of hash next to an equal 64-bit prefix.  Null or
wordless texts have no windows.  Rows with null doc_id are passed over.  Equal rows
are copies of one document and give equal results.  Rows that share a doc_id but not
the text are documents of their own, in the order of a hash of their texts (``key``).
Only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.words import U, Words, mix, signed, two_hashes, windows, words
from redline.sources.shared import keep, keep_narrow

WINDOW = 20
PREFIX = 6
REACH = WINDOW - PREFIX + 1  # places of a prefix in a window
LEFT = REACH - 1
SPAN = LEFT + WINDOW  # words around a place
GROUP = 20_000  # suffixes of one prefix in a task
BATCH = 40_000  # suffixes from which on a task builds trees
HIGH = U((1 << 40) - 1)
ROW = ["doc_id", "key"]


def sampled(w: Words) -> tuple[np.ndarray, ...]:
    """Sampled places (word index in the slice), prefix hashes, and the least and most words before them in their windows."""
    n = len(w.hash) - WINDOW + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) + (np.zeros(0, U),) + (np.zeros(0, np.int64),) * 2
    g = windows(w.hash, PREFIX)
    best, shift = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, REACH):
        better = g[j:j + n] < best
        best[better] = g[j:j + n][better]
        shift[better] = j
    start = np.flatnonzero(w.row[:n] == w.row[WINDOW - 1:])
    place = start + shift[start]
    new = np.flatnonzero(np.diff(place, prepend=-1))
    last = np.append(new[1:], len(place)) - 1 if len(place) else new
    at = place[new]
    return at, g[at], at - start[last], at - start[new]


def _content(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of the words of each row."""
    second = two_hashes(w.data, w.start, w.end)[1]
    out = []
    for h in (w.hash, second):
        turned = mix(h + (np.arange(len(h)) - w.bounds[:-1][w.row]).astype(U) * U(0x9E3779B97F4A7C15))
        sums = np.concatenate([np.zeros(1, U), np.cumsum(turned)])
        out.append(mix(sums[w.bounds[1:]] - sums[w.bounds[:-1]]))
    return out[0], out[1]


def _sizes(batches):
    for batch in batches:
        for w in words(batch.column(1)):
            h1, h2 = _content(w)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(w.first, w.rows), batch.column(2).slice(w.first, w.rows),
                pa.array(np.diff(w.bounds), pa.int64()), pa.array(signed(h1)), pa.array(signed(h2)),
            ], names=["doc_id", "key", "n_words", "h1", "h2"])


def _suffixes(batches):
    """prefix, doc_id, key, place in the document, and ``same``: alike only for the same place of equal documents."""
    for batch in batches:
        for w in words(batch.column(1)):
            at, prefix, _, _ = sampled(w)
            row = w.row[at]
            place = at - w.bounds[row]
            same = mix(_content(w)[0][row] + place.astype(U) * U(0xD1B54A32D192ED03))
            of = pa.array(w.first + row)
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(prefix)), batch.column(0).take(of), batch.column(2).take(of),
                pa.array(place.astype(np.int32)), pa.array(signed(same)),
            ], names=["prefix", "doc_id", "key", "place", "same"])


def _around(batches):
    """Of doc_id, text, live (2 * place + frequent), key: the words around each live suffix."""
    for batch in batches:
        lives = batch.column(2)
        size = np.asarray(lives.value_lengths())
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = np.asarray(lives.flatten()).astype(np.int64)
        for w in words(batch.column(1)):
            at, prefix, low, high = sampled(w)
            row = w.row[at]
            wanted = flat[ends[w.first]:ends[w.first + w.rows]]
            of = np.repeat(np.arange(w.rows), size[w.first:w.first + w.rows])
            own, live = (row << 32) + at - w.bounds[row], (of << 32) + wanted // 2
            hot, some = np.isin(own, live[wanted % 2 == 1]), np.isin(own, live)
            at, prefix, low, high, row, hot = (x[some] for x in (at, prefix, low, high, row, hot))
            index = at[:, None] + np.arange(-LEFT, WINDOW)
            inside = (index >= w.bounds[row][:, None]) & (index < w.bounds[row + 1][:, None])
            h = np.where(inside, w.hash[np.clip(index, 0, max(len(w.hash) - 1, 0))] & HIGH, U(0)) if len(at) else np.zeros((0, SPAN), U)
            data = np.concatenate([
                np.ascontiguousarray((h & U(0xFFFFFFFF)).astype("<u4")).view(np.uint8).reshape(-1, 4 * SPAN),
                (h >> U(32)).astype(np.uint8),
            ], axis=1)
            around = pa.FixedSizeBinaryArray.from_buffers(pa.binary(5 * SPAN), len(at), [None, pa.py_buffer(data.tobytes())])
            of = pa.array(w.first + row)
            yield pa.RecordBatch.from_arrays([
                pa.array(signed(prefix)), batch.column(0).take(of), batch.column(3).take(of),
                pa.array((at - w.bounds[row]).astype(np.int32)), pa.array(low.astype(np.int32)),
                pa.array(high.astype(np.int32)), pa.array(hot), around.cast(pa.binary()),
            ], names=["prefix", "doc_id", "key", "place", "low", "high", "hot", "around"])


def _nodes(prefix: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """Nodes of the trees of some groups: rows x (depth + 1), the node of a suffix at each depth."""
    order = np.lexsort([*columns.T[::-1], prefix])
    sorted_, p = columns[order], prefix[order]
    same = np.ones((len(order), columns.shape[1] + 1), bool)
    same[1:, 0] = p[1:] == p[:-1]
    same[1:, 1:] = sorted_[1:] == sorted_[:-1]
    same = np.logical_and.accumulate(same, axis=1)  # where the common prefix is at least that deep
    same[0] = False
    out = np.empty(same.shape, np.int64)
    out[order] = np.cumsum(~same, axis=0)
    return out


def mark(prefix, doc, key, place, low, high, around) -> np.ndarray:
    """Bit o of each suffix: the window that has o words before its place starts earlier elsewhere."""
    first = np.lexsort((place, key, doc))
    prefix, low, high, around = prefix[first], low[first], high[first], around[first]
    right, left = _nodes(prefix, around[:, LEFT:]), _nodes(prefix, around[:, :LEFT][:, ::-1])
    marks = np.zeros(len(first), np.int32)
    own = doc[first], key[first], place[first]
    for o in range(LEFT + 1):
        some = np.flatnonzero((low <= o) & (o <= high))
        node = right[some, WINDOW - o] * (len(first) + 1) + left[some, o]
        _, index, back = np.unique(node, return_index=True, return_inverse=True)
        lead = some[index[back]]
        later = np.logical_or.reduce([x[lead] != x[some] for x in own])
        marks[some[later]] |= 1 << o
    out = np.empty_like(marks)
    out[first] = marks
    return out


def _grow(batches):
    """Builds the trees of whole groups; the rows come sorted by prefix."""
    held: list[pa.RecordBatch] = []

    def ready(last: bool):
        nonlocal held
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        prefix = np.asarray(table.column(0))
        end = len(prefix) if last else int(np.searchsorted(prefix, prefix[-1]))
        held = [table.slice(end)] if end < len(prefix) else []
        if not end:
            return
        part = table.slice(0, end)
        data = np.frombuffer(b"".join(part.column(6).to_pylist()), np.uint8).reshape(-1, 5 * SPAN)
        around = np.ascontiguousarray(data[:, :4 * SPAN]).view("<u4").astype(U) | (data[:, 4 * SPAN:].astype(U) << U(32))
        doc, key, place, low, high = (np.asarray(part.column(i)) for i in range(1, 6))
        marks = mark(prefix[:end], doc, key, place, low, high, around)
        some = marks != 0
        yield pa.RecordBatch.from_arrays(
            [pa.array(x[some]) for x in (doc, key, place, marks)], names=["doc_id", "key", "place", "marks"]
        )

    rows = 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BATCH:
            yield from ready(False)
            rows = sum(b.num_rows for b in held)
    yield from ready(True)


def _whole_windows(frequent: DataFrame) -> DataFrame:
    """The same marks for frequent prefixes: prefixes as long as the window, first places as minima."""
    o = F.col("o")
    grown = frequent.select(
        "prefix", "doc_id", "key", "place", "around", F.explode(F.sequence("low", "high")).alias("o")
    ).select(
        "prefix", "doc_id", "key", "place", "o",
        F.xxhash64(F.substring("around", 4 * (LEFT - o) + 1, F.lit(4 * WINDOW)),
                   F.substring("around", 4 * SPAN + LEFT - o + 1, F.lit(WINDOW))).alias("w1"),
        F.hash(F.substring("around", 4 * (LEFT - o) + 1, F.lit(4 * WINDOW))).alias("w2"),
    )
    firsts = grown.groupBy("prefix", "o", "w1", "w2").agg(F.min(F.struct("doc_id", "key", "place")).alias("lead"))
    return (
        grown.join(firsts, ["prefix", "o", "w1", "w2"]).where(F.struct("doc_id", "key", "place") > F.col("lead"))
        .groupBy("doc_id", "key", "place").agg(F.expr("bit_or(CAST(pow(2, o) AS INT))").alias("marks"))
    )


def _copies(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents, and the doc_ids whose words are those of an earlier document."""
    sizes = keep(docs.mapInArrow(_sizes, "doc_id long, key long, n_words long, h1 long, h2 long"))
    long = sizes.where(F.col("n_words") >= WINDOW)
    first = long.groupBy("h1", "h2", "n_words").agg(F.min("doc_id").alias("lead"), F.max("doc_id").alias("last"))
    # stored, so that Spark sees both sizes and splits a group of very many copies
    several = keep_narrow(first.where("lead < last").drop("last"))
    copies = long.join(several, ["h1", "h2", "n_words"]).where("doc_id > lead").select(*ROW)
    return sizes, keep_narrow(copies.distinct())


def _marks(docs: DataFrame, copies: DataFrame, group: int) -> DataFrame:
    """``doc_id``, ``key``, ``place``, ``marks`` of every suffix with a repeated window, copies aside."""
    suffixes = docs.mapInArrow(_suffixes, "prefix long, doc_id long, key long, place int, same long")
    # stored, so that Spark sees the sizes of both sides of the join and splits a hot prefix
    shared = keep(suffixes.groupBy("prefix").agg(F.min("same").alias("low"), F.max("same").alias("high"))
                  .where("low <> high").select("prefix"))
    found = keep(
        suffixes.drop("same").join(shared, "prefix").join(copies, ROW, "left_anti")
    )
    frequent = keep_narrow(
        found.groupBy("prefix").count().where(F.col("count") > group).select("prefix", F.lit(1).alias("frequent"))
    )
    live = keep(
        found.join(frequent, "prefix", "left").groupBy(*ROW).agg(
            F.collect_list(F.col("place").cast("long") * 2 + F.coalesce("frequent", F.lit(0))).alias("live")
        )
    )
    around = keep(docs.join(live, ROW).select("doc_id", "text", "live", "key").mapInArrow(
        _around, "prefix long, doc_id long, key long, place int, low int, high int, hot boolean, around binary"
    ))
    trees = (
        around.where("NOT hot").drop("hot").repartition("prefix").sortWithinPartitions("prefix")
        .mapInArrow(_grow, "doc_id long, key long, place int, marks int")
    )
    return keep(trees.unionByName(_whole_windows(around.where("hot"))))


def _removal(w: Words, row_marks: list) -> np.ndarray:
    """Which words of a slice a marked window covers; row_marks: None, "copy" or (places, marks) for each row."""
    gone = np.zeros(len(w.hash) + 1, np.int32)
    for r, m in enumerate(row_marks):
        if m is None:
            continue
        if isinstance(m, str):
            gone[w.bounds[r]] += 1
            gone[w.bounds[r + 1]] -= 1
            continue
        place, marks = m
        for o in range(LEFT + 1):
            start = w.bounds[r] + place[(marks >> o) & 1 == 1] - o
            np.add.at(gone, start, 1)
            np.add.at(gone, start + WINDOW, -1)
    return np.cumsum(gone[:-1]) > 0


def _rows_with_marks(batch) -> Iterator[tuple[Words, np.ndarray]]:
    """Words of a batch of doc_id, text, copy, places, marks, and which of them go."""
    copy = batch.column(2).to_pylist()
    for w in words(batch.column(1)):
        places = batch.column(3).slice(w.first, w.rows).to_pylist()
        marks = batch.column(4).slice(w.first, w.rows).to_pylist()
        each = [
            "copy" if c else None if not p else (np.array(p, np.int64), np.array(m, np.int64))
            for c, p, m in zip(copy[w.first:w.first + w.rows], places, marks)
        ]
        yield w, _removal(w, each)


def kept_text(w: Words, stay: np.ndarray) -> list[bytes]:
    """The words of each row that stay, joined by one space."""
    s, size = w.start[stay], (w.end - w.start)[stay] + 1
    ends = np.concatenate([[0], np.cumsum(size)])
    index = np.repeat(s - ends[:-1], size) + np.arange(ends[-1])
    data = np.append(w.data, 0x20).astype(np.uint8)[np.minimum(index, len(w.data))] if len(index) else np.zeros(0, np.uint8)
    data[ends[1:] - 1] = 0x20
    rows = np.concatenate([[0], np.cumsum(np.bincount(w.row[stay], minlength=w.rows))])
    raw = data.tobytes()
    return [raw[ends[a]:max(ends[a], ends[b] - 1)] for a, b in zip(rows[:-1], rows[1:])]


def _marked(docs: DataFrame, group: int) -> DataFrame:
    docs = docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).withColumn("key", F.xxhash64("text"))
    _, copies = _copies(docs)
    by_doc = _marks(docs, copies, group).groupBy(*ROW).agg(F.collect_set(F.struct("place", "marks")).alias("m"))
    facts = by_doc.select(*ROW, "m", F.lit(False).alias("copy")).unionByName(
        copies.select(*ROW, F.lit(None).cast(by_doc.schema["m"].dataType).alias("m"), F.lit(True).alias("copy"))
    )
    return docs.join(facts, ROW, "left").select(
        "doc_id", "text", F.coalesce("copy", F.lit(False)).alias("copy"),
        F.col("m.place").alias("places"), F.col("m.marks").alias("marks"),
    )


def report(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """Per document: ``n_words``, ``n_removed`` and the SHA-256 of the words that stay."""

    def digest(batches):
        for batch in batches:
            for w, gone in _rows_with_marks(batch):
                n = np.diff(w.bounds)
                lost = np.bincount(w.row[gone], minlength=w.rows)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.first, w.rows), pa.array(n, pa.int64()), pa.array(lost, pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in kept_text(w, ~gone)]),
                ], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return _marked(docs, group).mapInArrow(digest, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, group: int = GROUP) -> DataFrame:
    """``doc_id``, ``text`` of the words that stay, joined by spaces, and ``spans``: first and past-last word of each run that went."""

    def rewrite(batches):
        for batch in batches:
            for w, gone in _rows_with_marks(batch):
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                border = np.zeros(len(edge), bool)
                border[w.bounds] = True
                begin = np.flatnonzero(gone & ((edge[:-1] == 1) | border[:-1]))
                end = np.flatnonzero(gone & ((edge[1:] == -1) | border[1:])) + 1
                row = w.row[begin]
                spans = [[] for _ in range(w.rows)]
                for r, a, b in zip(row.tolist(), (begin - w.bounds[row]).tolist(), (end - w.bounds[row]).tolist()):
                    spans[r].append([a, b])
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(w.first, w.rows),
                    pa.array([t.decode("utf-8", "replace") for t in kept_text(w, ~gone)]),
                    pa.array(spans, pa.list_(pa.list_(pa.int32()))),
                ], names=["doc_id", "text", "spans"])

    return _marked(docs, group).mapInArrow(rewrite, "doc_id long, text string, spans array<array<int>>")
