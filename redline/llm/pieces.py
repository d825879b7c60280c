"""Encoding into pieces of a SentencePiece model by a streaming Viterbi, and decoding.

The piece inventory, special ids and byte pieces come from a model file; each
piece has a log-probability.  A model trained for merges has ranks, not
probabilities: ``zipf`` gives the piece of rank r the score
``-round(1000 * ln(r + 2))``, Zipf's law in whole thousandths, so sums are
exact and ties are the same everywhere (the longer last piece of the earlier
start wins, as in a unigram model of the library).  ``own`` takes the scores as
they are.

Text becomes ``▁`` + text with ``▁`` for each space.  A character that no piece
covers becomes the byte pieces of its UTF-8 form, at ten points below the worst
piece.  The encoder keeps the lattice only since the last committed boundary:
when all surviving backpointer paths meet in one boundary, the ids before it are
final.  Decoding restores the text exactly, but for ``▁`` in a text itself,
which reads as a space (``round_trip`` is then false).

Null text: no ids, round trip null.  Empty text: the library gives no ids, so
does this.  Rows are independent: ties, repeats, extra columns have no effect.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.wordmemo import REMEMBERED, UnitMemo
from redline.llm.words import Words, words

SPACE = "▁"
#: Only space and newline part units; both begin a segment.
LINES = np.zeros(256, bool)
LINES[[0x0A, 0x20]] = True


class Pieces:
    """What a model file says, in the form the lattice needs."""

    def __init__(self, path: str, scores: str = "zipf"):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.text: list[str] = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = lambda i: model.is_control(i) or model.is_unknown(i) or model.is_unused(i)
        normal = [i for i in range(len(self.text)) if not special(i) and not model.is_byte(i)]
        score = {i: float(model.get_score(i)) for i in normal}
        if scores == "zipf":
            score = {i: -float(round(1000 * math.log(r + 2))) for r, i in enumerate(normal)}
        self.known = {self.text[i]: (score[i], i) for i in normal}
        self.longest = max(map(len, self.known), default=1)
        self.unknown = min(score.values(), default=0.0) - 10.0
        bytes_ = [i for i in range(len(self.text)) if model.is_byte(i)]
        self.byte = {int(self.text[i][1:-1], 16): i for i in bytes_}
        if len(self.byte) != 256:
            raise ValueError("the model has no byte pieces")
        self.data = [b""] * len(self.text)
        for i in normal:
            self.data[i] = self.text[i].replace(SPACE, " ").encode()
        for b, i in self.byte.items():
            self.data[i] = bytes([b])
        # a blank that follows another character begins a piece, and a character of no piece is one alone
        inner = any(SPACE in p.lstrip(SPACE) for p in self.known)
        alone = "\n" if not any("\n" in p for p in self.known) else ""
        self.parted = bool(alone) and not inner
        self.segment = re.compile(".+" if inner else f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+|\n", re.S)

    def ids_of(self, piece: str) -> list[int]:
        if piece in self.known:
            return [self.known[piece][1]]
        return [self.byte[b] for b in piece.encode("utf-8", "surrogatepass")]


def viterbi(pieces: Pieces, characters: Iterable[str], check: int = 64) -> Iterator[list[int]]:
    """Ids of a stream of text chunks, given out as soon as they are certain.

    State: the characters since the last committed boundary, and for each
    boundary behind them the best score and where its last piece began.  Only
    the last ``longest`` boundaries can be extended; every ``check`` characters
    their backpointers are followed until they meet.
    """
    known, longest, unknown = pieces.known, pieces.longest, pieces.unknown
    held, best, back = "", [0.0], [0]

    def path(end: int) -> list[int]:
        cuts = [end]
        while cuts[-1]:
            cuts.append(back[cuts[-1]])
        cuts.reverse()
        return [i for a, b in zip(cuts, cuts[1:]) for i in pieces.ids_of(held[a:b])]

    for chunk in characters:
        at = 0
        while at < len(chunk):
            held += chunk[at:at + check]
            at += check
            for end in range(len(best), len(held) + 1):
                top, start = -math.inf, end - 1
                for a in range(max(0, end - longest), end):
                    found = known.get(held[a:end])
                    if found is not None:
                        s = best[a] + found[0]
                    elif a == end - 1:
                        s = best[a] + unknown
                    else:
                        continue
                    if s > top:
                        top, start = s, a
                best.append(top)
                back.append(start)
            alive = set(range(max(0, len(held) + 1 - longest), len(held) + 1))
            while len(alive) > 1:
                last = max(alive)
                alive.remove(last)
                alive.add(back[last])
            meet = alive.pop()
            if meet:
                yield path(meet)
                held, base = held[meet:], best[meet]
                best = [s - base for s in best[meet:]]
                back = [max(0, b - meet) for b in back[meet:]]
    if held:
        yield path(len(held))


class Encoder:
    """Encodes texts; units between boundaries that no piece crosses are remembered.

    A unit is a word with the blanks before it, or the blanks at the end of a text.
    """

    def __init__(self, pieces: Pieces, remembered: int = REMEMBERED):
        self.pieces = pieces
        self.kind = np.uint16 if len(pieces.text) <= 1 << 16 else np.uint32
        self.memo = UnitMemo(lambda units: map(self.encode, units), self.kind, remembered)
        self.size = np.array([len(d) for d in pieces.data], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.data = np.frombuffer(b"".join(pieces.data), np.uint8)

    def encode(self, text: str) -> list[int]:
        """Ids of a text that has its leading space already."""
        segments = self.pieces.segment.findall(text.replace(" ", SPACE))
        return [i for s in segments for ids in viterbi(self.pieces, (s,)) for i in ids]

    def encode_all(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
        """Per slice: first row, rows, ids, where those of each row begin, and which rows decode to themselves."""
        for w in words(texts, LINES):
            first = np.zeros(len(w.start), bool)
            first[w.bounds[:-1][np.diff(w.bounds) > 0]] = True
            s = np.concatenate([w.row_start[:1], w.end[:-1]])[: len(w.start)]
            s[first] = w.row_start[:-1][w.row[first]]
            tail_from = w.row_start[:-1].copy()
            full = np.diff(w.bounds) > 0
            tail_from[full] = w.end[w.bounds[1:][full] - 1]
            tail = np.flatnonzero(tail_from < w.row_start[1:])
            s, e = np.concatenate([s, tail_from[tail]]), np.concatenate([w.end, w.row_start[1:][tail]])
            row = np.concatenate([w.row, tail])
            lead = np.concatenate([first, ~full[tail]])
            order = np.argsort(s, kind="stable")
            s, e, row, lead = s[order], e[order], row[order], lead[order]
            place = self.memo.places(w.data, s, e, lead) if self.pieces.parted else None
            if place is None:
                ids = [self.encode(" " + t) if t else [] for t in texts.slice(w.first, w.rows).to_pylist()]
                flat = np.array([i for x in ids for i in x], self.kind)
                at = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            else:
                flat, ends = self.memo.ids(place)
                at = ends[np.searchsorted(row, np.arange(w.rows + 1))]
            yield w.first, w.rows, flat, at, self._same(flat, at, w)

    def _same(self, flat: np.ndarray, at: np.ndarray, w: Words) -> np.ndarray:
        """Which rows of a slice are what their ids decode to."""
        size = self.size[flat]
        ends = np.concatenate([[0], np.cumsum(size)])
        decoded = self.data[np.repeat(self.begin[flat] - ends[:-1], size) + np.arange(ends[-1])]
        begin, end = ends[at[:-1]] + (at[1:] > at[:-1]), ends[at[1:]]  # without the leading space
        same = end - begin == np.diff(w.row_start)
        for i in np.flatnonzero(same):
            same[i] = np.array_equal(decoded[begin[i]:end[i]], w.data[w.row_start[i]:w.row_start[i + 1]])
        return same

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; control and unknown ids stand for nothing."""
        data = b"".join(map(self.pieces.data.__getitem__, ids.tolist()))
        return data.decode("utf-8", "replace").removeprefix(" ")


@lru_cache(maxsize=4)
def encoder(model: str, scores: str) -> Encoder:
    """One per worker process and model."""
    return Encoder(Pieces(model, scores))


def encode(docs: DataFrame, model: str, scores: str = "zipf") -> DataFrame:
    """Of ``doc_id``, ``text``: ``doc_id``, ``ids``, ``n_ids``, ``ids_crc32`` and ``round_trip``.

    ``model`` is the path of a model file, on every machine.  The text itself is
    not carried along; ``decode`` gives it back from the ids.
    """

    def run(batches):
        own = encoder(model, scores)
        for batch in batches:
            texts = batch.column(1)
            for first, rows, flat, at, same in own.encode_all(texts):
                null = np.asarray(texts.slice(first, rows).is_null())
                data = memoryview(flat.astype("<u4").tobytes())
                crc = [zlib.crc32(data[4 * a:4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
                lists = pa.ListArray.from_arrays(
                    pa.array(at, pa.int32(), mask=np.append(null, False)), pa.array(flat.astype(np.int32))
                )
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(first, rows), lists, pa.array(np.diff(at), mask=null),
                    pa.array(np.array(crc, np.int64), mask=null), pa.array(same, mask=null),
                ], names=["doc_id", "ids", "n_ids", "ids_crc32", "round_trip"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, ids array<int>, n_ids long, ids_crc32 long, round_trip boolean"
    )


def decode(encoded: DataFrame, model: str) -> DataFrame:
    """``doc_id`` and ``text`` of ``doc_id``, ``ids``; null ids give a null text."""

    def run(batches):
        own = encoder(model, "zipf")
        for batch in batches:
            texts = [None if x is None else own.decode(np.array(x, np.int64)) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
