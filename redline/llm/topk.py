"""Exact top-k by integer inner product, pruning blocks of rows by their bounds.

Every component x counts as floor(256 * x).  The rows stand in blocks of
``BLOCK`` neighbours by vec_id, each with the largest and smallest value of every
term (component) and its rows as a forward index.  A query orders the blocks by
the bound, the sum over its terms of weight times the largest value (the smallest
for a negative weight), scores them in that order and stops when the next bound
is below its k-th score.  A tie at the bound is still scored, so ties to smaller
vec_ids are exact.

Blocks lie in groups of ``GROUP`` blocks, queries in sets of ``QUERIES``; every
set meets every group once, as one unit of work, and the best k of all units are
merged.  A first pass over one group a set gives each query a k-th score to
start from.  That is the stated query set against all rows in blocks: work grows
as queries times rows where bounds do not prune, memory with neither.

Vectors that are null, hold a null or a non-finite component, and rows without
vec_id take no part.  Components of any finite size do: rows and queries whose
products could leave 62 bits are scored apart, in whole numbers of any length, and
a score beyond a long counts as the largest or smallest long.  Vectors of another
length than the query's are padded with zeros.  Rows that repeat a vec_id are candidates of
their own, but not for the query of that vec_id, which is asked once with the
largest of its vectors.  Fewer than k candidates give fewer rows.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redline.sources.shared import keep

BLOCK = 128
GROUP = 64
QUERIES = 1024
_MOST = float(np.finfo(np.float64).max)
_LONG = (-(1 << 63), (1 << 63) - 1)


def whole_vectors(rows: DataFrame) -> DataFrame:
    """``vec_id`` and ``v``: the components as whole numbers, in doubles, which hold each of them exactly."""

    def whole(c):
        x = F.lit(256.0) * c.cast("double")
        # doubles from 2^53 on are whole already; a product beyond all doubles is the largest one
        return F.when(F.abs(x) < 2.0**53, F.floor(x).cast("double")).otherwise(F.greatest(F.least(x, F.lit(_MOST)), F.lit(-_MOST)))

    x = F.transform("embedding", whole)
    fine = F.col("embedding").isNotNull() & F.forall(
        "embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf"))
    )
    return rows.where(F.col("vec_id").isNotNull() & fine).select(
        F.col("vec_id").cast("long").alias("vec_id"), x.alias("v")
    )


def _packed(per: int):
    """Rows of a partition, sorted by vec_id, in runs of ``per``: one row with the ids and the matrix."""

    def run(batches):
        ids, vectors, made = [], [], 0

        def row():
            nonlocal made
            made += 1
            width = max(map(len, vectors))
            m = np.zeros((len(vectors), width))
            for i, v in enumerate(vectors):
                m[i, : len(v)] = v
            return pa.RecordBatch.from_arrays(
                [pa.array([(TaskContext.get().partitionId() << 32) + made]), pa.array([np.array(ids, "<i8").tobytes()], pa.binary()),
                 pa.array([m.astype("<i4" if (np.abs(m) < 1 << 31).all() else "<f8").tobytes()], pa.binary()), pa.array([width], pa.int32())],
                names=["key", "ids", "matrix", "width"],
            )

        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids.append(i)
                vectors.append(v)
                if len(ids) == per:
                    yield row()
                    ids, vectors = [], []
        if ids:
            yield row()

    return run


PACKED = "key long, ids binary, matrix binary, width int"


def _unpack(ids: bytes, matrix: bytes, width: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, "<i8")
    kind = "<f8" if width and len(matrix) == 8 * len(i) * width else "<i4"
    m = np.frombuffer(matrix, kind).reshape(len(i), width)
    return i, m.astype(np.int64) if kind == "<i4" else m


def _pad(m: np.ndarray, width: int) -> np.ndarray:
    return np.pad(m, ((0, 0), (0, width - m.shape[1]))) if m.shape[1] < width else m


def search_unit(qi, q, di, d, k: int, least: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Best k rows of one group for each query: (query, ids, scores).  least: scores that are reached already."""
    width = max(q.shape[1], d.shape[1])
    q, d = _pad(q, width), _pad(d, width)
    most = math.sqrt((1 << 62) / max(width, 1))
    far_q, far_d = ((np.abs(m) >= most).any(1) for m in (q, d))
    if far_q.any() or far_d.any():
        return _far(qi, q, far_q, di, d, far_d, k, least)
    q, d = q.astype(np.int64), d.astype(np.int64)
    starts = np.arange(0, len(di), BLOCK)
    high, low = np.maximum.reduceat(d, starts), np.minimum.reduceat(d, starts)
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    out = []
    for j in range(len(qi)):
        best_id, best = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[j], kind="stable"):
            if bounds[j, b] < max(least[j], best[k - 1] if len(best) >= k else least[j]):
                break
            at = slice(starts[b], starts[b] + BLOCK)
            some = di[at] != qi[j]
            ids, scores = np.append(best_id, di[at][some]), np.append(best, (d[at] @ q[j])[some])
            order = np.lexsort((ids, -scores))[:k]
            best_id, best = ids[order], scores[order]
        out.append((int(qi[j]), best_id, best))
    return out


def _far(qi, q, far_q, di, d, far_d, k: int, least: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """As ``search_unit`` where some rows or queries are too large for 62 bits: those in Python's whole numbers."""
    near = np.flatnonzero(~far_d)
    plain = np.flatnonzero(~far_q)
    found = {}
    if len(near) and len(plain):
        for j, (_, ids, scores) in zip(plain, search_unit(qi[plain], q[plain], di[near], d[near], k, least[plain])):
            found[j] = (ids, scores)
    exact = [[int(c) for c in row] for row in d[far_d]]
    far = np.flatnonzero(far_d)
    out = []
    for j in range(len(qi)):
        weights = [(t, int(c)) for t, c in enumerate(q[j]) if c]
        ids, scores = found.get(j, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
        best = [(-int(s), int(i)) for i, s in zip(ids, scores)]
        rows = zip(far, exact)
        if far_q[j]:  # nothing is scored yet
            rows = ((r, [int(c) for c in d[r]]) for r in range(len(di)))
        for r, row in rows:
            if di[r] != qi[j]:
                score = sum(c * row[t] for t, c in weights)
                best.append((-min(max(score, _LONG[0]), _LONG[1]), int(di[r])))
        best = heapq.nsmallest(k, best)
        out.append((int(qi[j]), np.array([i for _, i in best], np.int64), np.array([-s for s, _ in best], np.int64)))
    return out


def _search(k: int):
    def run(batches):
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            for q_ids, q_m, q_w, d_ids, d_m, d_w, least in zip(*rows):
                qi, q = _unpack(q_ids, q_m, q_w)
                di, d = _unpack(d_ids, d_m, d_w)
                floor = np.frombuffer(least, "<i8") if least else np.full(len(qi), _LONG[0], np.int64)
                found = search_unit(qi, q, di, d, k, floor)
                sizes = [len(ids) for _, ids, _ in found]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(qi, sizes)), pa.array(np.concatenate([ids for _, ids, _ in found])),
                    pa.array(np.concatenate([s for _, _, s in found])),
                ], names=["query_id", "vec_id", "score"])

    return run


def _floors(k: int):
    """Each set of queries with the k-th score that one group gives them."""

    def run(batches):
        for batch in batches:
            rows = [c.to_pylist() for c in batch.columns]
            for number, q_ids, q_m, q_w, d_ids, d_m, d_w in zip(*rows):
                qi, q = _unpack(q_ids, q_m, q_w)
                di, d = _unpack(d_ids, d_m, d_w)
                found = search_unit(qi, q, di, d, k, np.full(len(qi), _LONG[0], np.int64))
                least = [int(s[k - 1]) if len(s) >= k else _LONG[0] for _, _, s in found]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([np.array(least, "<i8").tobytes()], pa.binary())], names=["number", "least"]
                )

    return run


def top_k(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` of the k best rows for every query."""
    spark = rows.sparkSession
    groups = keep(
        whole_vectors(rows).repartitionByRange("vec_id").sortWithinPartitions("vec_id", "v")
        .mapInArrow(_packed(BLOCK * GROUP), PACKED)
    )
    asked = whole_vectors(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    sets = keep(
        asked.repartitionByRange("vec_id").sortWithinPartitions("vec_id").mapInArrow(_packed(QUERIES), PACKED)
        .withColumnRenamed("key", "number")
    )
    n_groups = groups.count()
    if not n_groups:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # the keys alone are numbered, one short row for each group
    numbers = groups.select("key").withColumn("at", F.row_number().over(Window.orderBy("key")) - 1)
    placed = groups.join(numbers, "key")
    named = sets.select("number", F.col("ids").alias("q_ids"), F.col("matrix").alias("q_m"), F.col("width").alias("q_w"))
    own = placed.select("at", F.col("ids").alias("d_ids"), F.col("matrix").alias("d_m"), F.col("width").alias("d_w"))
    floors = keep(
        named.withColumn("at", F.pmod("number", F.lit(n_groups)).cast("int")).join(own, "at")
        .select("number", "q_ids", "q_m", "q_w", "d_ids", "d_m", "d_w").mapInArrow(_floors(k), "number long, least binary")
    )
    units = (
        named.join(floors, "number").withColumn("at", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1)))).join(own, "at")
        .select("q_ids", "q_m", "q_w", "d_ids", "d_m", "d_w", "least")
    )
    found = units.mapInArrow(_search(k), "query_id long, vec_id long, score long")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
