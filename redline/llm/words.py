"""Words of Arrow text columns as numpy arrays, without a Python loop per word.

Work goes by slices of about ``SLICE`` bytes of text, so memory stays small
whatever the batch; a single longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import NamedTuple

import numpy as np
import pyarrow as pa

SLICE = 1 << 20
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_LANES = 8  # longer words, rare ones, are digested one by one

#: Bytes between words: space, tab to carriage return.
BLANKS = np.zeros(256, bool)
BLANKS[[0x20, *range(0x09, 0x0E)]] = True
#: As above, and all other ASCII bytes that are neither letter nor digit.
PUNCTUATION = BLANKS.copy()
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True
SAME = np.arange(256, dtype=np.uint8)
#: A-Z to a-z, all other bytes as they are.
LOWER = SAME.copy()
LOWER[0x41:0x5B] += 0x20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)  # the first k bytes of a lane
_SEEDS = (U(0xD1B54A32D192ED03), U(0xC2B2AE3D27D4EB4F))


class Words(NamedTuple):
    """Words of the rows ``first`` to ``first + rows - 1`` of a column."""

    first: int
    rows: int
    data: np.ndarray  # the bytes of the slice
    row: np.ndarray  # of each word, from 0 in the slice
    start: np.ndarray  # byte offset in data
    end: np.ndarray
    hash: np.ndarray  # 64 bits
    bounds: np.ndarray  # the words of row i are bounds[i] to bounds[i + 1] - 1
    row_start: np.ndarray  # byte offset of each row, and of the end


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column; a null is an empty text."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1]
    return at, np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)


def slices(at: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of rows with about SLICE bytes each."""
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + SLICE, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def words(texts: pa.Array, breaks: np.ndarray = BLANKS, fold: np.ndarray = SAME, hashed: bool = True) -> Iterator[Words]:
    """Maximal runs of bytes that are not in breaks, hashed after fold."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not len(texts):
        return
    at, data = buffers(texts)
    for i, j in slices(at):
        part, base = data[at[i]:at[j]], int(at[i])
        starts = (at[i:j + 1] - base).astype(np.int64)
        n = len(part)
        inside = np.zeros(n + 2, bool)
        inside[1:-1] = ~breaks[part]
        begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
        edge = starts[:-1][starts[:-1] < starts[1:]]  # a text ends a word, also without a blank
        begins[edge] = inside[1:-1][edge]
        before = edge[edge > 0] - 1
        ends[before] = inside[1:-1][before]
        s, e = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        h = _hashes(part, s, e, fold, 0) if hashed else np.zeros(0, U)
        bounds = np.searchsorted(s, starts)
        row = np.repeat(np.arange(j - i), np.diff(bounds))
        yield Words(i, j - i, part, row, s, e, h, bounds, starts)


def _hashes(part: np.ndarray, s: np.ndarray, e: np.ndarray, fold: np.ndarray, which: int) -> np.ndarray:
    """64 bits of each range of bytes.

    Eight bytes at a time are mixed into what came before, so the hash is not
    linear in any of them; ranges of over ``8 * _LANES`` bytes get BLAKE2.
    """
    size = e - s
    data = np.zeros(len(part) + 8, np.uint8)
    data[:len(part)] = part if fold is SAME else fold[part]
    lanes = np.ndarray(len(part) + 1, "<u8", data, strides=(1,))
    h = mix(size.astype(U) * U(_BASE) + _SEEDS[which])
    some = np.flatnonzero((size > 0) & (size <= 8 * _LANES))
    for k in range(_LANES):
        if k:
            some = some[size[some] > 8 * k]
        if not len(some):
            break
        lane = lanes[s[some] + 8 * k] & _MASK[np.minimum(size[some] - 8 * k, 8)]
        h[some] = mix((h[some] ^ lane) * U(_BASE) + _SEEDS[which])
    for i in np.flatnonzero(size > 8 * _LANES):
        digest = blake2b(data[s[i]:e[i]].tobytes(), digest_size=16).digest()
        h[i] = int.from_bytes(digest[8 * which:8 * which + 8], "little")
    return h


def two_hashes(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of 64 bits for each range of bytes, mixed from different seeds."""
    return _hashes(data, s, e, SAME, 0), _hashes(data, s, e, SAME, 1)


def windows(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of every run of k consecutive hashes; runs may cross rows, see ``whole``."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.zeros(n, U)
    for j in range(k):
        out *= U(_BASE)
        out += h[j:j + n]
    return mix(out)


def whole(row: np.ndarray, k: int) -> np.ndarray:
    """Which runs of k words lie within one row."""
    n = len(row) - k + 1
    return row[:n] == row[k - 1:k - 1 + n] if n > 0 else np.zeros(0, bool)


def signed(h: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return h.view(np.int64)
