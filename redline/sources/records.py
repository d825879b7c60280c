"""Records of quoted CSV files, read by many tasks however large a file is.

A line break ends a record only outside quotes, and a task that begins in the
middle of a file cannot know on which side it is.  So every range of a file is
first judged for both cases: where it ends and how many records begin in it, if
it begins outside quotes and if it begins inside.  These pairs, one short row for
each range, are chained along the file; then every range is cut into records.
What lies across a border comes in pieces, two for each range at most, and is put
together by file.  Ranges number the records as well, so no row is sorted.

A quote opens a cell only as its first character; in a cell that does not begin
with one it is text.  Inside, two quotes are one; after the closing quote the rest
of the cell is text.  Blank lines are no records.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redline.sources.shared import keep

#: Ranges that begin inside quotes are sent to all tasks up to this number (some 100 bytes each).
MOST_SENT = 500_000
_RANGE = ["file", "start"]


def open_after(line: str, inside: bool) -> bool:
    """Whether a cell is still in quotes at the end of a line that begins inside or outside."""
    at = 0
    while True:
        if not inside:
            quote = line.find('"', at)
            if quote < 0:
                return False
            if quote > at and line[quote - 1] != ",":
                at = line.find(",", quote) + 1
                if not at:
                    return False
                continue
            at = quote + 1
        end = line.find('"', at)
        while end >= 0 and line[end + 1:end + 2] == '"':
            end = line.find('"', end + 2)
        if end < 0:
            return True
        at = line.find(",", end) + 1
        if not at:
            return False
        inside = False


def _runs(batches) -> Iterator[tuple[str, int, list[str], list[bool]]]:
    """Lines of a task by file and range, as they come: (file, start, lines, which have quotes)."""
    for batch in batches:
        file, start = batch.column(1).to_pylist(), batch.column(2).to_pylist()
        lines, quoted = batch.column(0).to_pylist(), pc.match_substring(batch.column(0), '"').to_pylist()
        begin = 0
        for i in range(1, len(lines) + 1):
            if i == len(lines) or start[i] != start[begin] or file[i] != file[begin]:
                yield file[begin], start[begin], lines[begin:i], quoted[begin:i]
                begin = i


def _judge(batches):
    """Per range, for a begin outside and inside of quotes: whether it ends inside, and how many records begin in it."""
    last, ends, n = None, [False, True], [0, 0]

    def row():
        return pa.RecordBatch.from_arrays(
            [pa.array([last[0]]), pa.array([last[1]]), *(pa.array([x]) for x in (*ends, *n))],
            names=["file", "start", "ends0", "ends1", "n0", "n1"],
        )

    for file, start, lines, quoted in _runs(batches):
        if (file, start) != last:
            if last:
                yield row()
            last, ends, n = (file, start), [False, True], [0, 0]
        for line, q in zip(lines, quoted):
            for k in (0, 1):
                n[k] += not ends[k] and line not in ("", "\r")
                if q:
                    ends[k] = open_after(line, ends[k])
    if last:
        yield row()


def _cut(batches):
    """The records of every range; ``i`` counts those that begin in it.  ``piece``: 0 whole, 1 without its end, 2 without its begin."""
    last, inside, held, i = None, False, [], 0

    def close(out, ended: bool) -> None:
        nonlocal held, i
        if held:
            headless = i < 0
            out.append((*last, max(i, 0), (2 if ended else 3) if headless else (0 if ended else 1), "\n".join(held)))
            held = []
            i = 0 if headless else i + 1

    def batch_of(out):
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()))],
            names=["file", "start", "i", "piece", "record"],
        )

    for batch in batches:
        out: list = []
        states = batch.column(3).to_pylist()
        row = 0
        for file, start, lines, quoted in _runs([batch]):
            if (file, start) != last:
                close(out, False)
                last, inside, held = (file, start), states[row], []
                i = -1 if inside else 0  # what comes first belongs to a record from before
            row += len(lines)
            for line, q in zip(lines, quoted):
                if not inside and line in ("", "\r"):
                    continue
                held.append(line)
                if q:
                    inside = open_after(line, inside)
                if not inside:
                    close(out, True)
        if out:
            yield batch_of(out)
    out = []
    close(out, False)
    if out:
        yield batch_of(out)


def records(spark: SparkSession, path: str) -> DataFrame | None:
    """``row_index`` and ``record`` of all records but the first of each file, in order of file names and places.

    None if more ranges begin inside quotes than may be sent to all tasks.
    """
    lines = spark.read.text(str(path), lineSep="\n").select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start")
    )
    judged = keep(lines.mapInArrow(
        _judge, "file string, start long, ends0 boolean, ends1 boolean, n0 long, n1 long"
    ).coalesce(max(1, spark.sparkContext.defaultParallelism)))
    # A range either keeps, flips or sets the state.  The last one that sets it, and the flips since, give the state.
    along = Window.partitionBy("file").orderBy("start")
    sets = F.when(F.col("ends0") == F.col("ends1"), F.col("ends0").cast("int"))
    flips = F.when(F.col("ends0") & ~F.col("ends1"), 1).otherwise(0)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    ranges = judged.select(
        "*", F.coalesce(F.last(sets, True).over(before), F.lit(0)).alias("set"), sets.isNotNull().cast("int").alias("is_set"), flips.alias("flip")
    ).select("*", F.coalesce(F.sum("is_set").over(before), F.lit(0)).alias("since"))
    # flips count from the range after the one that set the state
    since = Window.partitionBy("file", "since").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    state = (F.col("set") + F.coalesce(F.sum("flip").over(since), F.lit(0))) % 2 == 1
    ranges = ranges.select(*_RANGE, state.alias("inside"), F.col("n0"), F.col("n1")).select(
        *_RANGE, "inside", F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0")).alias("n")
    )
    ranges = keep(ranges.select("*", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier")))
    begun_inside = ranges.where("inside").select(*_RANGE, "inside")
    if begun_inside.count() > MOST_SENT:
        return None
    pieces = lines.join(F.broadcast(begun_inside), _RANGE, "left").select(
        "value", "file", "start", F.coalesce("inside", F.lit(False)).alias("inside")
    ).mapInArrow(_cut, "file string, start long, i long, piece int, record string")
    whole = pieces.where("piece = 0").drop("piece")
    # a piece without its begin belongs to the last one before it that has one
    order = Window.partitionBy("file").orderBy("start", "part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    broken = pieces.where("piece > 0").withColumn("part", F.when(F.col("piece") == 1, 1).otherwise(0))
    mended = (
        broken.withColumn("of", F.sum("part").over(order)).groupBy("file", "of").agg(
            F.min_by(F.struct("start", "i"), F.struct("start", "part")).alias("at"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "part", "record"))), lambda x: x["record"]), "\n").alias("record"),
        ).select("file", "at.start", "at.i", "record")
    )
    files = ranges.groupBy("file").agg(F.sum("n").alias("n"))
    # one row for each file
    rows = F.coalesce(F.sum(F.greatest(F.col("n") - 1, F.lit(0))).over(
        Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = ranges.join(files.select("file", (rows - 1).alias("shift")), "file").select(*_RANGE, "earlier", "shift")
    return (
        whole.unionByName(mended).join(shifts, _RANGE).withColumn("in_file", F.col("earlier") + F.col("i"))
        .where("in_file > 0").select((F.col("in_file") + F.col("shift")).alias("row_index"), "record")
    )
