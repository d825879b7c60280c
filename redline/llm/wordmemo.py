"""Encoding of texts by the units in them, each different unit once.

Where no token spans the border of two units, a text has the ids of its units,
one after the other.  The ids of units seen are remembered in arrays, a unit by
128 bits of hash, at about 35 bytes each; an encoder is asked for the others.
The memory lives as long as the worker process and starts anew when full, which
changes no result.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa

from redline.llm.words import Words, two_hashes, words

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are parallel already
from tokenizers import Tokenizer  # noqa: E402

REMEMBERED = 1_500_000


class UnitMemo:
    def __init__(self, encode: Callable[[list[str]], Iterator[list[int]]], kind: type, remembered: int = REMEMBERED):
        self.encode, self.kind, self.remembered = encode, kind, remembered
        self._clear()

    def _clear(self) -> None:
        self.key, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.at, self.count = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flat, self.used = np.zeros(1 << 16, self.kind), 0

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        place = np.searchsorted(self.key, keys)
        known = place < len(self.key)
        known[known] = self.key[place[known]] == keys[known]
        return place, known

    def _learn(self, keys: np.ndarray, checks: np.ndarray, new: list[str]) -> None:
        """keys ascend and none of them is known."""
        ids, counts = [], []
        for x in self.encode(new):
            ids += x
            counts.append(len(x))
        more = np.array(ids, self.kind)
        if self.used + len(more) > len(self.flat):
            grown = np.zeros(2 * (self.used + len(more)), self.kind)
            grown[: self.used] = self.flat[: self.used]
            self.flat = grown
        self.flat[self.used:self.used + len(more)] = more
        counts = np.array(counts, np.int32)
        at = self.used + np.cumsum(counts, dtype=np.int64) - counts
        self.used += len(more)
        place = np.searchsorted(self.key, keys)
        self.key, self.check = np.insert(self.key, place, keys), np.insert(self.check, place, checks)
        self.at, self.count = np.insert(self.at, place, at), np.insert(self.count, place, counts)

    def places(self, data: np.ndarray, s: np.ndarray, e: np.ndarray, lead: np.ndarray | None = None) -> np.ndarray | None:
        """Where the ids of each unit of bytes are; None if two units share a hash of 64 bits.

        A unit with ``lead`` is taken with a space before it.
        """
        first, second = two_hashes(data, s, e)
        if lead is not None:
            first = first ^ np.where(lead, np.uint64(0xD6E8FEB86659FD93), np.uint64(0))
        keys, index, back = np.unique(first, return_index=True, return_inverse=True)
        if len(self.key) + len(keys) > self.remembered:
            self._clear()
        place, known = self._find(keys)
        if not known.all():
            some, raw = index[~known], data.tobytes()
            new = [raw[a:b].decode("utf-8", "replace") for a, b in zip(s[some].tolist(), e[some].tolist())]
            if lead is not None:
                new = [" " + x if y else x for x, y in zip(new, lead[some].tolist())]
            self._learn(keys[~known], second[some], new)
            place, _ = self._find(keys)
        place = place[back]
        return place if (self.check[place] == second).all() else None

    def ids(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all units in a row, and where those of each unit begin and the last end."""
        counts = self.count[place].astype(np.int64)
        ends = np.concatenate([[0], np.cumsum(counts)])
        return self.flat[np.repeat(self.at[place] - ends[:-1], counts) + np.arange(ends[-1])], ends


class WordIds:
    """For tokenizers files that drop white space: the units are words."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if self.size <= 1 << 16 else np.uint32
        self.memo = UnitMemo(self._library, self.kind, remembered)

    def _library(self, texts: list[str]) -> Iterator[list[int]]:
        for i in range(0, len(texts), 1000):
            for got in self.tokenizer.encode_batch_fast(texts[i:i + 1000], add_special_tokens=False):
                yield got.ids

    def _whole(self, texts: pa.Array, w: Words) -> Iterator[list[int]]:
        return self._library([t or "" for t in texts.slice(w.first, w.rows).to_pylist()])

    def encode(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of every text, in order; a null is an empty text."""
        for w in words(texts):
            place = self.memo.places(w.data, w.start, w.end)
            if place is None:
                yield from (np.array(x, self.kind) for x in self._whole(texts, w))
            else:
                flat, ends = self.memo.ids(place)
                yield from np.split(flat, ends[w.bounds[1:-1]])

    def counts(self, texts: pa.Array) -> np.ndarray:
        """How many ids every text has."""
        out = [np.zeros(0, np.int64)]
        for w in words(texts):
            place = self.memo.places(w.data, w.start, w.end)
            if place is None:
                out.append(np.array([len(x) for x in self._whole(texts, w)], np.int64))
            else:
                ends = np.concatenate([[0], np.cumsum(self.memo.count[place].astype(np.int64))])
                out.append(np.diff(ends[w.bounds]))
        return np.concatenate(out)


@lru_cache(maxsize=4)
def word_ids(path: str) -> WordIds:
    """One per worker process and tokenizer."""
    return WordIds(path)
