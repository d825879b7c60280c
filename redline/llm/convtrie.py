"""Prefix trie of conversations by collapsing whole sequences.

A node is a distinct sequence of the first d turns (role, text); the root has no
turns.  Its members are the conversations that start with it.

1. Turns are numbered by a sort over ranges of (conv_id, turn), so that one very
   long conversation loads no single task, and known by the SHA-256 of role and
   text.  A prefix is known by a chain of SHA-256 over its turns; chains start anew
   every ``BLOCK`` turns, and a short chain over whole blocks ties them together.
2. Conversations with the same whole sequence collapse to one weighted sequence,
   named after its smallest conv_id; who ends there is its end list.  However many
   copies there are, only one of them goes on.
3. Sequences that are a proper prefix of another drop out by an anti-join; those
   left are the leaves.
4. Weights are summed over all prefixes, combined before the shuffle.  Sums over
   subtrees need no walk: each node counts on the path of one leaf below it, the
   smallest, and a node's sum is what the paths of its leaves count, less what
   its own path counts above it.

Null roles and texts are empty.  Null turns come first; turns that tie in number
are ordered by the SHA-256 of role and text, and equal ones both count.  Rows with
null conv_id take no part.  A table without conversations gives no node, not even
the root.  Only conv_id, turn, role and text are read.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from redline.sources.shared import keep

BLOCK = 1024  # turns
LISTED = 50_000  # ids in one piece of an end list
ROOT = bytes(16)


def numbered(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``conv_id``, ``place`` from 1, ``said`` (SHA-256) and ``n_bytes`` of every turn; and ``conv_id``, ``n`` of every conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)).alias("said"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )

    def count(batches):
        part, last, n = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            c = np.asarray(batch.column(0))
            starts = np.concatenate([[0], np.flatnonzero(np.diff(c)) + 1])
            ends = np.append(starts[1:], len(c))
            i = np.arange(len(c)) - np.repeat(starts, ends - starts) + 1
            if c[0] == last:
                i[: ends[0]] += n
            last, n = c[-1], i[-1]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(c), part, np.int32)), pa.array(i), batch.column(2), batch.column(3)],
                names=["conv_id", "part", "i", "said", "n_bytes"],
            )

    order = ["conv_id", "turn", "said"]
    rows = keep(turns.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(
        count, "conv_id long, part int, i long, said binary, n_bytes long"
    ))
    parts = keep(rows.groupBy("conv_id", "part").agg(F.max("i").alias("n")))
    lengths = parts.groupBy("conv_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"))
    # few conversations lie in several ranges: no more than there are ranges
    before = F.sum("n").over(Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    later = keep(
        parts.join(lengths.where("parts > 1").select("conv_id"), "conv_id")
        .select("conv_id", "part", before.alias("before")).where("before IS NOT NULL")
    )
    places = rows.join(later, ["conv_id", "part"], "left").select(
        "conv_id", (F.col("i") + F.coalesce("before", F.lit(0))).alias("place"), "said", "n_bytes"
    )
    return places, lengths.select("conv_id", "n")


def rebuilt(conversations: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """As ``numbered``, for conversations whose first turns come from another one.

    Conversation c takes its first h = crc32(c) % most turns from conversation
    c - c % every (all if there are fewer, none without it), then its own after
    its first h.
    """
    places, lengths = numbered(conversations)
    places, lengths = keep(places), keep(lengths)
    c = F.col("conv_id")
    other = lengths.where(c % every == 0).select(c.alias("base"), F.col("n").alias("n_base"))
    plan = keep(
        lengths.select(c, "n", (c - c % every).alias("base"), (F.crc32(c.cast("string")) % most).alias("h"))
        .join(other, "base", "left")
        .select(c, "base", "n", "h", F.least("h", F.coalesce("n_base", F.lit(0))).alias("taken"))
    )
    own = places.join(plan, "conv_id").where("place > h").select(
        c, (F.col("place") - F.col("h") + F.col("taken")).alias("place"), "said", "n_bytes"
    )
    heads = places.where((c % every == 0) & (F.col("place") < most)).withColumnRenamed("conv_id", "base")
    first = heads.join(plan.where("taken > 0"), "base").where("place <= taken").select(c, "place", "said", "n_bytes")
    return own.unionByName(first), plan.select(
        c, (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("n")
    )


def _chains(block: int):
    """The chain before and after each turn of a block; rows come sorted by conv_id and place."""

    def run(batches):
        last, state = None, b""
        for batch in batches:
            before, after = [], []
            for c, p, said in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2))):
                if c != last or (p - 1) % block == 0:
                    state = b""
                before.append(state)
                state = sha256(state + said).digest()
                after.append(state)
                last = c
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(before, pa.binary()), pa.array(after, pa.binary())],
                names=["conv_id", "place", "n_bytes", "n", "before", "after"],
            )

    return run


def _ties(batches):
    """The chain over whole blocks that stands before each later block."""
    last, state = None, b""
    for batch in batches:
        out = []
        for c, after in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            state = after if c != last else sha256(state + after).digest()
            out.append(state)
            last = c
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=["conv_id", "block", "tie"])


def prefixes(places: DataFrame, lengths: DataFrame, block: int = BLOCK) -> DataFrame:
    """``conv_id``, ``depth``, ``n`` (whole length), ``node``, ``parent``, ``n_bytes`` of every prefix but the root."""
    at = F.floor((F.col("place") - 1) / block)
    dealt = places.join(lengths, "conv_id").select("conv_id", "place", "said", "n_bytes", "n").withColumn("block", at)
    rows = keep(
        dealt.repartition("conv_id", "block").sortWithinPartitions("conv_id", "place")
        .select("conv_id", "place", "said", "n_bytes", "n")
        .mapInArrow(_chains(block), "conv_id long, place long, n_bytes long, n long, before binary, after binary")
    )
    whole = rows.where((F.col("place") % block == 0) & (F.col("place") < F.col("n")))
    ties = keep(
        whole.select("conv_id", (F.col("place") / block).cast("long").alias("block"), "after")
        .repartition("conv_id").sortWithinPartitions("conv_id", "block")
        .mapInArrow(_ties, "conv_id long, block long, tie binary")
    )

    def known(chain: Column) -> Column:
        tied = F.unhex(F.sha2(F.concat("tie", chain), 256))
        return F.substring(F.when(F.col("tie").isNull(), chain).otherwise(tied), 1, 16)

    parent = (
        F.when(F.col("place") == 1, F.lit(ROOT)).when(F.length("before") == 0, F.substring("tie", 1, 16)).otherwise(known(F.col("before")))
    )
    return rows.withColumn("block", at).join(ties, ["conv_id", "block"], "left").select(
        "conv_id", F.col("place").alias("depth"), "n", known(F.col("after")).alias("node"), parent.alias("parent"), "n_bytes"
    )


def collapse(paths: DataFrame, lengths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``node``, ``conv_id`` of every conversation's whole sequence, and the weighted sequences: ``node``, ``seq``, ``weight``."""
    ends = keep(
        paths.where("depth = n").select("node", "conv_id")
        .unionByName(lengths.where("n = 0").select(F.lit(ROOT).alias("node"), "conv_id"))
    )
    return ends, keep(ends.groupBy("node").agg(F.min("conv_id").alias("seq"), F.count(F.lit(1)).alias("weight")))


def end_lists(ends: DataFrame, listed: int = LISTED) -> DataFrame:
    """``node``, ``first``, ``ids``: the ascending conv_ids that end in a node, joined by commas, in pieces of bounded size."""

    def pieces(batches):
        for batch in batches:
            node, ids = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out, begin = [], 0
            for i in range(1, len(node) + 1):
                if i == len(node) or node[i] != node[begin] or i - begin == listed:
                    out.append((node[begin], ids[begin], ",".join(map(str, ids[begin:i]))))
                    begin = i
            if out:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*out), (pa.binary(), pa.int64(), pa.string()))], names=["node", "first", "ids"]
                )

    return ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(
        pieces, "node binary, first long, ids string"
    )


def end_digests(ends: DataFrame, listed: int = LISTED) -> DataFrame:
    """``node``, ``ends_sha256``: SHA-256 of each whole end list, fed piece by piece."""

    def digest(batches):
        last, state = None, None
        for batch in batches:
            out = []
            for node, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if node != last:
                    if last is not None:
                        out.append((last, state.hexdigest()))
                    last, state = node, sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _digests(out)
        if last is not None:
            yield _digests([(last, state.hexdigest())])

    return end_lists(ends, listed).repartition("node").sortWithinPartitions("node", "first").mapInArrow(
        digest, "node binary, ends_sha256 string"
    )


def _digests(rows: list) -> pa.RecordBatch:
    nodes, hexes = zip(*rows) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hexes, pa.string())], names=["node", "ends_sha256"])


def _before(nodes: DataFrame, block: int) -> DataFrame:
    """``node``, ``owner``, ``above``: what the path of its owner counts above each node; a running sum in two levels."""
    up_to = Window.orderBy("depth").rowsBetween(Window.unboundedPreceding, -1)
    counted = nodes.select("node", "owner", "depth", "saved", F.floor(F.col("depth") / block).alias("block"))
    blocks = counted.groupBy("owner", "block").agg(F.sum("saved").alias("s"))
    earlier = blocks.select("owner", "block", F.sum("s").over(
        Window.partitionBy("owner").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    ).alias("earlier"))
    inside = F.sum("saved").over(up_to.partitionBy("owner", "block"))
    return counted.select("node", "owner", "block", F.coalesce(inside, F.lit(0)).alias("inside")).join(
        earlier.where("earlier IS NOT NULL"), ["owner", "block"], "left"
    ).select("node", (F.col("inside") + F.coalesce("earlier", F.lit(0))).alias("above"))


def trie(places: DataFrame, lengths: DataFrame, block: int = BLOCK, listed: int = LISTED) -> DataFrame:
    """One row per node: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens`` and ``ends_sha256``."""
    paths = keep(prefixes(places, lengths, block))
    ends, sequences = collapse(paths, lengths)
    weighted = keep(
        paths.join(sequences.select("seq", "weight"), paths.conv_id == F.col("seq"))
        .select("seq", "weight", "depth", "n", "node", "parent", "n_bytes")
        .unionByName(sequences.select(
            "seq", "weight", F.lit(0).cast("long").alias("depth"), F.when(F.col("node") == F.lit(ROOT), 0).otherwise(1).cast("long").alias("n"),
            F.lit(ROOT).alias("node"), F.lit(None).cast("binary").alias("parent"), F.lit(0).cast("long").alias("n_bytes"),
        ))
    )
    inner = weighted.where("depth < n").select("node").distinct()
    leaves = keep(sequences.join(inner, "node", "left_anti").select("seq", F.lit(1).alias("leaf")))
    saved = (F.col("n_convs") - 1) * F.col("n_bytes")
    nodes = keep(
        weighted.join(leaves, "seq", "left").groupBy("node", "parent", "depth", "n_bytes").agg(
            F.sum("weight").alias("n_convs"), F.min("seq").alias("conv_id"), F.count("leaf").alias("n_leaves"),
            F.min(F.when(F.col("leaf") == 1, F.col("seq"))).alias("owner"),
        ).select("node", "parent", "depth", "n_convs", "conv_id", "n_leaves", "owner", saved.alias("saved"))
    )
    paid = keep(nodes.groupBy("owner").agg(F.sum("saved").alias("paid")))
    below = weighted.join(paid, weighted.seq == paid.owner).groupBy("node").agg(F.sum("paid").alias("below"))
    children = nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count(F.lit(1)).alias("n_children"))
    full = (
        nodes.join(below, "node").join(_before(nodes, block), "node")
        .join(children.withColumnRenamed("parent", "node"), "node", "left")
        .join(end_digests(ends, listed), "node", "left")
    )
    parents = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, "parent", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves",
        (F.col("below") - F.col("above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )


#: The same for the query, on DuckDB: every node by its list of turns, subtrees by joining nodes to all their prefixes.
SQL = """
WITH RECURSIVE ids AS (SELECT DISTINCT conv_id, CAST(conv_id AS VARCHAR) AS s FROM conversations WHERE conv_id IS NOT NULL),
bits AS (
  SELECT conv_id, s, CAST(4294967295 AS BIGINT) AS c, 0 AS i FROM ids
  UNION ALL
  SELECT conv_id, s, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END,
    xor(c, CAST(ascii(s[i + 1]) AS BIGINT))), i + 1 FROM bits WHERE i < length(s)
), h AS (SELECT conv_id, xor(c, 4294967295) % 9 AS h FROM bits WHERE i = length(s)),
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS p
  FROM conversations WHERE conv_id IS NOT NULL
), r AS (
  SELECT h.conv_id, 0 AS own, p, role, text FROM h JOIN t ON t.conv_id = h.conv_id - h.conv_id % 5 AND p <= h
  UNION ALL SELECT h.conv_id, 1, p, role, text FROM h JOIN t ON t.conv_id = h.conv_id AND p > h
), m AS (
  SELECT h.conv_id, coalesce(list({'role': role, 'text': text} ORDER BY own, p) FILTER (p IS NOT NULL), []) AS turns
  FROM h LEFT JOIN r USING (conv_id) GROUP BY 1
), n AS (
  SELECT conv_id, depth, turns[1:depth] AS node, depth = len(turns) AS here
  FROM (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM m)
), nodes AS (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (here), '')) AS ends_sha256
  FROM n GROUP BY node, depth
), named AS (
  SELECT a.*, p.conv_id AS parent_conv_id, a.depth > 0 AS child,
    CASE WHEN a.depth = 0 THEN 0 ELSE (a.n_convs - 1) * octet_length(encode(a.node[a.depth].text)) END AS saved
  FROM nodes a LEFT JOIN nodes p ON a.depth > 0 AND p.depth = a.depth - 1 AND p.node = a.node[1:a.depth - 1]
), kids AS (SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM named WHERE child GROUP BY ALL),
up AS (SELECT n.*, k.n_children, unnest(range(0, n.depth + 1)) AS d FROM named n LEFT JOIN kids k USING (conv_id, depth)),
sums AS (
  SELECT node[1:d] AS node, sum(saved) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves FROM up GROUP BY node[1:d]
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, n.parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves,
  CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM named n JOIN sums s ON s.node = n.node LEFT JOIN kids k ON k.conv_id = n.conv_id AND k.depth = n.depth
"""
