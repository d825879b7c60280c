"""The few functions Spark has no expression for, as Arrow-batched UDFs.

Matching is that of ``difflib.SequenceMatcher`` without junk: take the longest
common block (the earliest in the first text, then in the second), then go on
left and right of it.  Everything built on it (ratio, added, deleted) is plain
column arithmetic over the number of matched characters.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from redline.functions import text as X

# Below this product of lengths the standard library is faster than hashing.
# Like the next three it chooses between ways to the same result.
_SMALL = 64 * 64
# Lengths of blocks that are looked for together, longest first.
_RUNGS = (40, 10, 4, 2, 1)
# Places that meet at a rung per character, beyond which blocks are looked for one by one.
_MEET = 16
# Length tried first; blocks that unrelated texts share are about this long.
_GUESS = 12
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _prefix_hashes(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and polynomial prefix sums modulo 2**64."""
    powers = np.ones(len(codes) + 1, dtype=np.uint64)
    np.multiply.accumulate(np.full(len(codes), _BASE), out=powers[1:])
    sums = np.zeros(len(codes) + 1, dtype=np.uint64)
    np.cumsum(codes * powers[:-1], out=sums[1:], dtype=np.uint64)
    return powers, sums


class _Windows:
    """Hashes of all windows of one length inside a stretch of a text."""

    def __init__(self, text: str, size: int):
        raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
        # Spread the code points, as neighbouring values would make weak hashes.
        mixed = (raw + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
        self.codes = mixed ^ (mixed >> np.uint64(29))
        self.sums = _prefix_hashes(self.codes)[1]
        self.size = size

    def of(self, lo: int, hi: int, width: int, powers: np.ndarray) -> np.ndarray:
        heads = self.sums[lo : hi - width + 1]
        tails = self.sums[lo + width : hi + 1]
        # Bring each window to one common power so that equal texts hash alike.
        return (tails - heads) * powers[self.size - lo - np.arange(hi - width - lo + 1)]


def _longest_block(a, b, wa, wb, powers, alo, ahi, blo, bhi):
    """Longest common block of two stretches: (start in a, start in b, length)."""
    longest = min(ahi - alo, bhi - blo)
    low, high, best = 1, longest, None
    width = min(_GUESS, high)
    while low <= high:
        ha, hb = wa.of(alo, ahi, width, powers), wb.of(blo, bhi, width, powers)
        ordered = np.sort(hb)
        place = np.minimum(np.searchsorted(ordered, ha), len(ordered) - 1)
        hit = ordered[place] == ha
        if hit.any():
            i = int(np.argmax(hit))
            j = int(np.argmax(hb == ha[i]))
            if a[alo + i : alo + i + width] != b[blo + j : blo + j + width]:
                return None  # two texts with one hash: let the caller fall back
            best = (alo + i, blo + j, width)
            low = width + 1
            # Double while nothing has failed yet: most blocks are short.
            width = min(2 * width, high) if high == longest else (low + high) // 2
        else:
            high = width - 1
            width = (low + high) // 2
    return best or (alo, blo, 0)


def _small(a: str, b: str) -> int:
    blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
    return sum(block.size for block in blocks)


def _segments(wa, wb, powers, alo, ahi, blo, bhi, width):
    """All longest possible common blocks of ``width`` or more: starts in a, starts in b, lengths.

    None if more places meet than the stretches' lengths allow.
    """
    ha, hb = wa.of(alo, ahi, width, powers), wb.of(blo, bhi, width, powers)
    order = np.argsort(hb, kind="stable")
    ordered = hb[order]
    first = np.searchsorted(ordered, ha)
    hit = np.flatnonzero(ordered[np.minimum(first, len(ordered) - 1)] == ha)
    if not len(hit):
        return (), (), ()
    first = first[hit]
    count = np.searchsorted(ordered, ha[hit], side="right") - first
    met = int(count.sum())
    if met > _MEET * (len(ha) + len(hb)) + 1024:
        return None
    i = np.repeat(hit, count)
    j = order[np.repeat(first - (np.cumsum(count) - count), count) + np.arange(met)]
    # Neighbours on one diagonal are one block.
    span = len(ha) + 1
    place = np.sort((j - i + len(ha)) * span + i)
    begin = np.ones(met, bool)
    begin[1:] = place[1:] != place[:-1] + 1
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, met)) + width - 1
    i = place[at] % span
    j = place[at] // span - len(ha) + i
    return i + alo, j + blo, size


def _cut(found, alo, ahi, blo, bhi, width):
    """The parts of blocks inside two stretches, as far as they have ``width``."""
    i, j, size = found
    if len(i) <= 24:
        out = []
        for x, y, n in zip(i, j, size):
            skip = max(alo - x, blo - y, 0)
            n = min(n, ahi - x, bhi - y) - skip
            if n >= width:
                out.append((x + skip, y + skip, n))
        return tuple(zip(*out)) if out else ((), (), ())
    skip = np.maximum(np.maximum(alo - i, blo - j), 0)
    n = np.minimum(np.minimum(size, ahi - i), bhi - j) - skip
    stay = np.flatnonzero(n >= width)
    if len(stay) <= 24:
        return (i + skip)[stay].tolist(), (j + skip)[stay].tolist(), n[stay].tolist()
    return (i + skip)[stay], (j + skip)[stay], n[stay]


def _longest(found):
    """The longest block, the earliest in a, then in b."""
    i, j, size = found
    if len(i) <= 24:
        n, x, y = min((-n, x, y) for x, y, n in zip(i, j, size))
        return x, y, -n
    best = np.flatnonzero(size == size.max())
    k = best[np.lexsort((j[best], i[best]))[0]]
    return int(i[k]), int(j[k]), int(size[k])


def matched_length(a: str, b: str) -> int:
    """Number of characters two texts share under longest-block matching.

    The blocks of a rung's length or more are found together; they are cut to the
    stretches left and right of each longest one.  A stretch that holds none of
    them goes on at the next rung, so each text is sorted once per rung, however
    many blocks it shares with the other.
    """
    if a == b:
        return len(a)
    if len(a) * len(b) <= _SMALL:
        return _small(a, b)
    size = max(len(a), len(b))
    wa, wb = _Windows(a, size), _Windows(b, size)
    powers = _prefix_hashes(np.zeros(size, dtype=np.uint64))[0]
    total, todo = 0, [(0, len(a), 0, len(b), 0, None)]
    while todo:
        alo, ahi, blo, bhi, rung, found = todo.pop()
        if alo >= ahi or blo >= bhi:
            continue
        width = _RUNGS[rung]
        if found is not None:
            found = _cut(found, alo, ahi, blo, bhi, width)
            if not len(found[0]):
                rung, found = rung + 1, None
        if found is None:
            if (ahi - alo) * (bhi - blo) <= _SMALL:
                total += _small(a[alo:ahi], b[blo:bhi])
                continue
            while rung < len(_RUNGS):
                width = _RUNGS[rung]
                if width <= min(ahi - alo, bhi - blo):
                    found = _segments(wa, wb, powers, alo, ahi, blo, bhi, width)
                    if found is None or len(found[0]):
                        break
                rung += 1
            else:
                continue  # no character in common
        block = _longest(found) if found is not None else _longest_block(a, b, wa, wb, powers, alo, ahi, blo, bhi)
        if block is not None:
            i, j, width = block
            if a[i:i + width] != b[j:j + width]:
                block = None  # two texts with one hash
        if block is None:
            total += _small(a[alo:ahi], b[blo:bhi])
            continue
        total += width
        todo += [(alo, i, blo, j, rung, found), (i + width, ahi, j + width, bhi, rung, found)]
    return total


@F.pandas_udf(T.LongType())
def _matched(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([matched_length(x, y) for x, y in zip(a, b)], dtype="int64")


def order_ratio(a: list, b: list) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


@F.pandas_udf(T.DoubleType())
def label_order_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Similarity of two label sequences; call it on distinct pairs only."""
    return pd.Series(
        [order_ratio(list(x), list(y)) for x, y in zip(a, b)],
        dtype="float64",
    )


@F.pandas_udf(T.DoubleType())
def python_round(values: pd.Series, digits: pd.Series) -> pd.Series:
    """Rounding on the exact binary value, where parity with ``round`` is needed."""
    return pd.Series(
        [None if pd.isna(v) else round(float(v), int(d)) for v, d in zip(values, digits)],
        dtype="float64",
    )


def with_char_edits(df, before: str, after: str):
    """Add ``char_edit_ratio``, ``added_chars`` and ``deleted_chars``.

    Only pairs that differ after normalization cross over to Python.
    """
    df = df.withColumn("_na", X.normalize(F.col(before))).withColumn(
        "_nb", X.normalize(F.col(after))
    )
    df = df.withColumn(
        "_pair",
        F.when(F.col("_na") != F.col("_nb"), F.struct(F.col("_na").alias("a"), F.col("_nb").alias("b"))),
    )
    # Equal pairs reach the UDF as two empty texts.
    df = df.withColumn(
        "_m",
        _matched(X.text(F.col("_pair.a")), X.text(F.col("_pair.b"))),
    )
    na, nb = F.length("_na").cast("bigint"), F.length("_nb").cast("bigint")
    matched = F.when(F.col("_pair").isNull(), na).otherwise(F.col("_m"))
    return (
        df.withColumn("added_chars", nb - matched)
        .withColumn("deleted_chars", na - matched)
        .withColumn(
            "char_edit_ratio",
            F.when(na + nb == 0, F.lit(0.0)).otherwise(1.0 - (2.0 * matched) / (na + nb)),
        )
        .drop("_na", "_nb", "_pair", "_m")
    )

