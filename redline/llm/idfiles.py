"""Token-id files: each id in the fewest bits of the vocabulary, in blocks.

Layout of a file::

    magic | packed blocks | doc ids, known, starts (int64, uint8, int64) |
    block offsets (int64) | JSON | length of the JSON (uint32) | magic

A block holds ``block`` ids (the last one fewer), each in ``bits`` bits, low
bits first, filled up to a multiple of 64 ids.  ``starts`` counts the ids of
the file before each document.  A reader needs the tail and then any run of
blocks, so documents and ids are found without reading the rest.

Documents are dealt out by ranges of doc_id, one file per range, so ascending
file names are ascending doc_ids.  A file is written under the name of its
attempt and renamed when complete: a lost or repeated task leaves no torn file.
Nulls in doc_id come first; a null text is an empty one; rows that share a
doc_id stand in the order of their texts; an empty table gives no file.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from redline.llm.wordmemo import word_ids
from redline.sources.shared import new_folder

MAGIC = b"IDFILE1\n"
BLOCK = 1 << 16
MANIFEST = "part int, file string, n_docs long, n_ids long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def bits_for(vocabulary: int) -> int:
    """The fewest bits that tell apart the ids 0 to vocabulary - 1."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Every 64 ids become ``bits`` words of 64 bits."""
    n = -(-len(ids) // 64)
    v = np.zeros((n, 64), np.uint64)
    v.ravel()[: len(ids)] = ids
    out = np.zeros((n, bits + 1), np.uint64)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        out[:, word] |= v[:, j] << np.uint64(shift)
        if shift + bits > 64:
            out[:, word + 1] |= v[:, j] >> np.uint64(64 - shift)
    return np.ascontiguousarray(out[:, :bits]).astype("<u8").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first n ids of a packed block as unsigned 32-bit integers."""
    w = np.frombuffer(data, "<u8").reshape(-1, bits)
    out, mask = np.empty((len(w), 64), np.uint32), np.uint64((1 << bits) - 1)
    for j in range(64):
        word, shift = divmod(j * bits, 64)
        x = w[:, word] >> np.uint64(shift)
        if shift + bits > 64:
            x = x | (w[:, word + 1] << np.uint64(64 - shift))
        out[:, j] = x & mask
    return out.ravel()[:n]


class Writer:
    def __init__(self, sink, bits: int, block: int = BLOCK):
        self.sink, self.bits, self.block = sink, bits, block
        self.docs: list[int | None] = []
        self.starts, self.offsets = [0], [len(MAGIC)]
        self.open, self.held = [], 0
        sink.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.open.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            rest = np.concatenate(self.open)
            while len(rest) >= self.block:
                self._put(rest[: self.block])
                rest = rest[self.block:]
            self.open, self.held = [rest], len(rest)

    def _put(self, ids: np.ndarray) -> None:
        data = pack(ids, self.bits)
        self.sink.write(data)
        self.offsets.append(self.offsets[-1] + len(data))

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.open))
        known = np.array([d is not None for d in self.docs], np.uint8)
        self.sink.write(np.array([d or 0 for d in self.docs], "<i8").tobytes() + known.tobytes())
        self.sink.write(np.array(self.starts, "<i8").tobytes() + np.array(self.offsets, "<i8").tobytes())
        info = {"bits": self.bits, "block": self.block, "docs": len(self.docs), "blocks": len(self.offsets) - 1}
        tail = json.dumps(info).encode()
        self.sink.write(tail + len(tail).to_bytes(4, "little") + MAGIC)


class Reader:
    """Random access: ``doc(i)`` and ``ids(start, end)`` read only the blocks they need."""

    def __init__(self, source):
        self.source, size = source, source.size()
        end = self._at(size - len(MAGIC) - 4, len(MAGIC) + 4)
        if end[4:] != MAGIC:
            raise ValueError("not a complete id file")
        n = int.from_bytes(end[:4], "little")
        info = json.loads(self._at(size - len(end) - n, n))
        self.bits, self.block, docs, blocks = info["bits"], info["block"], info["docs"], info["blocks"]
        tail = docs * 17 + 8 + (blocks + 1) * 8
        data = self._at(size - len(end) - n - tail, tail)
        numbers = np.frombuffer(data, "<i8", docs)
        known = np.frombuffer(data, np.uint8, docs, docs * 8)
        self.docs = [int(d) if k else None for d, k in zip(numbers, known)]
        self.starts = np.frombuffer(data, "<i8", docs + 1, docs * 9)
        self.offsets = np.frombuffer(data, "<i8", blocks + 1, docs * 17 + 8)

    def _at(self, start: int, n: int) -> bytes:
        self.source.seek(start)
        return self.source.read(n)

    def ids(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, np.uint32)
        first, last = start // self.block, (end - 1) // self.block
        data = self._at(int(self.offsets[first]), int(self.offsets[last + 1] - self.offsets[first]))
        base, parts = int(self.offsets[first]), []
        for b in range(first, last + 1):
            n = min(self.block, int(self.starts[-1]) - b * self.block)
            parts.append(unpack(data[int(self.offsets[b]) - base:int(self.offsets[b + 1]) - base], self.bits, n))
        return np.concatenate(parts)[start - first * self.block:end - first * self.block]

    def doc(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))

    def all_docs(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """Every document with its start, several blocks at a time."""
        i, n = 0, len(self.docs)
        while i < n:
            j = max(i + 1, int(np.searchsorted(self.starts, self.starts[i] + 4 * self.block, "right")) - 1)
            j, base = min(j, n), int(self.starts[i])
            ids = self.ids(base, int(self.starts[j]))
            for k in range(i, j):
                yield self.docs[k], int(self.starts[k]), ids[self.starts[k] - base:self.starts[k + 1] - base]
            i = j


def write(docs: DataFrame, folder: str, tokenizer: str, end_id: int, block: int = BLOCK) -> DataFrame:
    """Encode ``doc_id``, ``text`` into id files below folder; gives one row per file.

    ``tokenizer`` is the path of a tokenizers file, on every machine.  Each
    document gets ``end_id`` at its end.
    """

    def put(batches):
        encoder, writer, sink = word_ids(tokenizer), None, None
        where, root = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, end = f"part-{part:06d}.ids", np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode(batch.column(1))):
                if writer is None:
                    where.create_dir(root, recursive=True)
                    sink = where.open_output_stream(f"{root}/.{name}.{attempt}")
                    writer = Writer(sink, bits_for(encoder.size), block)
                writer.add(doc_id, np.concatenate([ids, end]))
        if writer is not None:
            writer.close()
            sink.close()
            where.move(f"{root}/.{name}.{attempt}", f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({
                "part": pa.array([part], pa.int32()), "file": [name],
                "n_docs": [len(writer.docs)], "n_ids": [writer.starts[-1]],
            })

    manifest = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(put, MANIFEST)
    )
    manifest.write.mode("overwrite").parquet(f"{folder}/_manifest")
    return docs.sparkSession.read.schema(MANIFEST).parquet(f"{folder}/_manifest")


def read(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of the files: ``doc_id``, ``start`` over all files, ``n_tokens``, ``ids_crc32``.

    The running sum has one row per file, the files themselves are read by all tasks.
    """
    spark = manifest.sparkSession
    before = F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    files = manifest.select("file", F.coalesce(before, F.lit(0)).alias("base"))

    def get(batches):
        where, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows = []
                with where.open_input_file(f"{root}/{name}") as source:
                    for doc_id, start, ids in Reader(source).all_docs():
                        rows.append((doc_id, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        if len(rows) == 10_000:
                            yield _rows(rows)
                            rows = []
                yield _rows(rows)

    return files.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "file").mapInArrow(get, RESULT)


def _rows(rows: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[]] * 4
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=list(names))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write all documents, read the files back."""
    folder = new_folder(docs.sparkSession, "ids")
    return read(write(docs, folder, tokenizer, end_id), folder)
