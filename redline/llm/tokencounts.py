"""Token totals by source, language and tokenizer version, kept up to date by deltas.

A batch is a set of signed rows: an insert adds a document and its tokens, a delete
takes them off, a revision takes the old count off and adds the new one, perhaps
under another version.  Totals are sums, so a batch is added up before it is
stored and no earlier row is read again.

A batch is committed once: its rows are written aside and renamed to a folder
named after the batch (in hexadecimal, so any name will do), and a batch whose folder is there, or that a compaction
took up, is passed over.  An interrupted commit leaves only its own folder aside,
which no reader looks at.  ``compact`` merges all batches into one that names those
it replaces; one writer at a time is assumed.

Null source, lang or version are values of their own.  A null or empty text has 0
tokens.  Repeated rows count as often as they stand there.  Totals of no document
and no token are left out; an empty batch is committed too.  Further columns of
the deltas do not matter.
"""

from __future__ import annotations

import json
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redline.llm.wordmemo import word_ids

KEYS = ("source", "lang", "version")
_COMPACT = "compact "
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


def measure(docs: DataFrame, tokenizer: str, version: str, added: int = 0) -> DataFrame:
    """``doc_id``, ``source``, ``lang``, ``version``, ``n_tokens`` of every document.

    ``tokenizer`` is the path of a tokenizers file that drops white space, on every
    machine; ``added`` ids are counted on top for each document.
    """

    def run(batches):
        own = word_ids(tokenizer)
        for batch in batches:
            n = own.counts(batch.column(3)) + added
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([version] * len(n), pa.string()), pa.array(n)],
                names=["doc_id", "source", "lang", "version", "n_tokens"],
            )

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, source string, lang string, version string, n_tokens long")


def signed_rows(measured: DataFrame, sign: int) -> DataFrame:
    """Deltas of an insert (1) or a delete (-1) of measured documents."""
    return measured.select(*KEYS, F.lit(sign).cast("long").alias("n_docs"), (F.col("n_tokens") * sign).alias("n_tokens"))


def revision(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deltas that put new measurements in the place of old ones."""
    return signed_rows(old, -1).unionByName(signed_rows(new, 1))


class Rollup:
    """The totals below a folder that all machines share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _committed(self) -> dict[str, list[str]]:
        """Batches with a folder, and which each of them replaces."""
        top = self._path(f"{self.folder}/batches")
        if not self._fs.exists(top):
            return {}
        found = {bytes.fromhex(s.getPath().getName()).decode(): [] for s in self._fs.listStatus(top)}
        # only compactions replace others: usually one, so a commit reads one small file however many batches there are
        for name in found:
            if name.startswith(_COMPACT):
                folder = f"{self.folder}/batches/{name.encode().hex()}"
                found[name] = json.loads(self.spark.read.schema("value string").text(f"{folder}/replaces").first()[0])
        return found

    def _store(self, batch_id: str, rows: DataFrame, replaces: list[str]) -> None:
        aside = f"{self.folder}/aside/{uuid.uuid4().hex}"
        rows.write.parquet(f"{aside}/rows")
        if replaces:
            self.spark.createDataFrame([(json.dumps(replaces),)], "value string").write.text(f"{aside}/replaces")
        name = batch_id.encode().hex()
        target = self._path(f"{self.folder}/batches/{name}")
        self._fs.mkdirs(target.getParent())
        # a rename onto a folder that is there nests or fails; both mean that another writer was first
        moved = not self._fs.exists(target) and self._fs.rename(self._path(aside), target)
        if moved and self._fs.exists(self._path(target, aside.rsplit("/", 1)[1])):
            self._fs.delete(self._path(target, aside.rsplit("/", 1)[1]), True)
            moved = False
        if not moved:
            raise OSError(f"batch {batch_id} could not be put in place")

    def commit(self, batch_id: str, deltas: DataFrame) -> bool:
        """Add a batch; False if it is there already."""
        if batch_id.startswith(_COMPACT):
            raise ValueError(f"names of batches do not begin with {_COMPACT!r}")
        known = self._committed()
        if batch_id in known or any(batch_id in r for r in known.values()):
            return False
        self._store(batch_id, deltas.groupBy(*KEYS).agg(
            F.sum("n_docs").cast("long").alias("n_docs"), F.sum("n_tokens").cast("long").alias("n_tokens")
        ), [])
        return True

    def totals(self) -> DataFrame:
        known = self._committed()
        replaced = {b for r in known.values() for b in r}
        live = [f"{self.folder}/batches/{b.encode().hex()}/rows" for b in known if b not in replaced]
        if not live:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*live).groupBy(*KEYS).agg(
            F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")
        ).where("n_docs <> 0 OR n_tokens <> 0")

    def compact(self) -> None:
        """Merge all batches into one; their names stay known."""
        known = self._committed()
        names = sorted(set(known) | {b for r in known.values() for b in r})
        if len(known) > 1:
            self._store(f"{_COMPACT}{uuid.uuid4().hex}", self.totals(), names)
