"""Near-duplicate documents by a chosen-path set similarity join.

A document is the set of its different runs of ``WORDS`` words (A-Z
lower-cased; a shorter document is one run), and links to another if the
Jaccard similarity of their sets is ``percent`` / 100 or more.  Links make
components, each named after its smallest doc_id.

1. Equal sets collapse to their smallest doc_id; their documents are linked.
2. Every different set gets ``COORDINATES`` minwise tokens.
3. ``trees`` independent trees branch the sets: a node picks on average
   100 / percent of the coordinates, at least one, and a set goes to one child for
   each, named by its token there.  Sets of similarity s keep s * 100 / percent
   common children on average, so likely sets stay together and others part.
   Only nodes of more than ``small`` sets branch, at most ``depth`` times.
4. In every node all sets are compared with a pivot, drawn anew in each tree;
   pairs whose tokens make the similarity possible are confirmed on the full sets.
   That joins most groups with a row per set, however large they are.
5. Then all pairs of a node that are not yet in one component are compared, by
   tokens first, then on the full sets.  A node is one unit as long as its sets fit
   a block (``BLOCK`` sets, ``ROOM`` shingles); beyond that each pair of blocks is a
   unit of its own; nothing is capped.  A unit gives only links that join two
   components, fewer than it has sets, so groups of many documents near the limit
   cost comparisons in memory, but no rows.

Recall: a pair at the limit stays together in a tree of depth d with about
0.85^d or more; with 12 trees, less than 1 in 10^4 such pairs is never compared,
and a component needs only some of its links.  A pair is wrongly left out by its
tokens if five standard deviations fewer agree than expected at the limit.

Null, empty or wordless texts have an empty set and link with nothing.  Rows with
null doc_id are passed over by ``report`` and kept by ``apply``; rows that share a
doc_id are one document with the sets of each row.  Only doc_id and text are read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from redline.llm.components import components
from redline.llm.words import BLANKS, LOWER, U, mix, signed, windows, words
from redline.sources.shared import keep, keep_narrow

WORDS = 5
COORDINATES = 64
BLOCK = 4096  # sets of a node compared at a time: a megabyte of tokens
ROOM = 1 << 22  # shingles of a block: 32 MB
_SEEDS = mix(np.arange(1, COORDINATES + 1, dtype=U) * U(0x9E3779B97F4A7C15))


def shingle_sets(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Per slice: first row, rows, all sorted different shingles, and where those of each row begin."""
    for w in words(texts, BLANKS, LOWER):
        size = np.diff(w.bounds)
        count = np.where(size >= WORDS, size - WORDS + 1, (size > 0).astype(np.int64))
        runs = windows(w.hash, WORDS)
        at = np.repeat(w.bounds[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row = np.repeat(np.arange(w.rows), count)
        h = np.zeros(len(at), U)
        long = (size >= WORDS)[row]
        h[long] = runs[at[long]]
        for r in np.flatnonzero((size > 0) & (size < WORDS)):  # a short text is one run of its own size
            h[np.searchsorted(row, r)] = windows(w.hash[w.bounds[r]:w.bounds[r + 1]], int(size[r]))[0] ^ U(size[r])
        order = np.lexsort((h, row))
        h, row = h[order], row[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
        yield w.first, w.rows, h, np.searchsorted(row, np.arange(w.rows + 1))


def _tokens(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Minwise tokens of non-empty sets: rows x COORDINATES of 32 bits."""
    out = np.empty((len(at) - 1, COORDINATES), np.uint32)
    for c, seed in enumerate(_SEEDS):
        out[:, c] = np.minimum.reduceat(((h ^ seed) * (seed | U(1))) >> U(32), at[:-1])
    return out


def _describe(batches):
    """doc_id, set size, 128 bits of hash of the set, tokens."""
    for batch in batches:
        for first, rows, h, at in shingle_sets(batch.column(1)):
            n = np.diff(at)
            full = np.flatnonzero(n)
            sums, tokens = np.zeros((2, rows), np.int64), [None] * rows
            if len(full):
                some = np.append(at[full], at[-1])
                for k in (0, 1):
                    sums[k, full] = signed(mix(np.add.reduceat(mix(h + U(k)), some[:-1])))
                data = _tokens(h, some).tobytes()
                for i, r in enumerate(full):
                    tokens[r] = data[4 * COORDINATES * i:4 * COORDINATES * (i + 1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, rows), pa.array(n, pa.int64()), pa.array(sums[0]), pa.array(sums[1]),
                 pa.array(tokens, pa.binary())], names=["doc_id", "n", "h1", "h2", "tokens"],
            )


def describe(docs: DataFrame) -> DataFrame:
    return docs.where("doc_id IS NOT NULL").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    ).mapInArrow(_describe, "doc_id long, n long, h1 long, h2 long, tokens binary")


def least_equal(percent: int) -> int:
    """Equal tokens that a pair at the limit has but for one case in a million."""
    p = percent / 100
    return int(COORDINATES * p - 5 * (COORDINATES * p * (1 - p)) ** 0.5)


def _token(c: Column) -> Column:
    return F.substring("tokens", c * 4 + 1, F.lit(4))


def _children(rows: DataFrame, percent: int) -> DataFrame:
    """``path``, ``set_id``, ``n``, ``tokens`` one level down: each path picks one coordinate, some paths a second."""
    more = int(1000 * (100 / percent - 1))
    pick = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(COORDINATES)).cast("int")
    again = F.pmod(F.xxhash64("path", F.lit(2)), F.lit(COORDINATES)).cast("int")
    second = F.when(F.pmod(F.xxhash64("path", F.lit(3)), F.lit(1000)) < more, again)
    return rows.select(
        "set_id", "n", "tokens", "path", F.explode(F.array_compact(F.array(pick, second))).alias("c")
    ).select(
        "set_id", "n", "tokens", F.xxhash64("path", "c", _token(F.col("c"))).alias("path")
    )


def _nodes(sets: DataFrame, percent: int, trees: int, depth: int, small: int) -> DataFrame:
    """``path``, ``set_id``, ``n`` of the last node of every path that holds two sets at least."""
    done = []
    level = sets.select(
        "set_id", "n", "tokens", F.explode(F.sequence(F.lit(1), F.lit(trees))).alias("tree")
    ).select(
        # the first coordinates of the trees are all different
        "set_id", "n", F.explode(F.when(F.col("tree") % 6 == 0, F.array("tree", F.col("tree") + trees)).otherwise(F.array("tree"))).alias("c"),
        "tokens", "tree",
    ).select("set_id", "n", F.xxhash64("tree", "c", _token(F.col("c"))).alias("path"))
    for d in range(1, depth + 1):
        level = keep(level.distinct())
        size = level.groupBy("path").count().where("count > 1")
        if d == depth:
            done.append(level.join(size.select("path"), "path", "left_semi"))
            break
        size = keep_narrow(size)
        done.append(level.join(size.where(F.col("count") <= small).select("path"), "path", "left_semi"))
        large = level.join(size.where(F.col("count") > small).select("path"), "path", "left_semi")
        level = _children(large.join(sets.select("set_id", "tokens"), "set_id"), percent).select("set_id", "n", "path")
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def _pivot_pairs(nodes: DataFrame) -> DataFrame:
    """``a``, ``b``: every set with the pivot of its nodes."""
    drawn = F.xxhash64("path", "set_id")
    pivots = nodes.groupBy("path").agg(F.min_by("set_id", drawn).alias("b"))
    return nodes.join(pivots, "path").where("set_id <> b").select(
        F.least("set_id", "b").alias("a"), F.greatest("set_id", "b").alias("b")
    ).distinct()


def _likely(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs with enough equal tokens."""
    left = sets.select(F.col("set_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("set_id").alias("b"), F.col("tokens").alias("tb"))
    enough = least_equal(percent)

    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, COORDINATES) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).sum(1) >= enough))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(agree, "a long, b long")


def _confirmed(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""

    def exact(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                whole = [list(_sets(part.column(k))) for k in (2, 3)]
                keep_ = []
                for x, y in zip(*whole):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep_.append(100 * both >= percent * (len(x) + len(y) - both))
                yield part.select([0, 1]).filter(pa.array(keep_, pa.bool_()))

    left = texts.select(F.col("set_id").alias("a"), F.col("text").alias("ta"))
    right = texts.select(F.col("set_id").alias("b"), F.col("text").alias("tb"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "ta", "tb").mapInArrow(exact, "a long, b long")


def _sets(texts: pa.Array) -> Iterator[np.ndarray]:
    for _, rows, h, at in shingle_sets(texts):
        for r in range(rows):
            yield h[at[r]:at[r + 1]]


def _whole_sets(batches):
    """set_id and its sorted shingles."""
    for batch in batches:
        for first, rows, h, at in shingle_sets(batch.column(1)):
            data = [h[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, rows), pa.array(data, pa.binary())], names=["set_id", "shingles"]
            )


def _units(named: DataFrame) -> DataFrame:
    """``unit``, ``set_id``, ``component``, ``block``: sets of the nodes with more than one component, dealt to blocks.

    Each pair of blocks of a node is a unit; a node whose sets fit one block is one, and has a row per set.
    """
    node = named.groupBy("path").agg(
        F.count(F.lit(1)).alias("count"), F.sum("n").alias("room"), F.min("component").alias("low"), F.max("component").alias("high"),
        F.expr("bit_xor(xxhash64(set_id))").alias("x"), F.expr("bit_xor(xxhash64(set_id, 1))").alias("y"),
    ).where("low <> high")
    # trees often have nodes of the same sets: one of them is enough
    open_ = node.groupBy("count", "room", "x", "y").agg(F.min("path").alias("path")).select(
        "path", F.ceil(F.greatest(F.col("count") / BLOCK, F.col("room") / ROOM)).cast("int").alias("blocks")
    )
    return named.join(open_, "path").withColumn(
        "block", F.pmod(F.xxhash64("set_id"), F.col("blocks")).cast("int")
    ).select(
        "path", "set_id", "component", "block",
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"),
    ).select(
        F.xxhash64("path", F.least("block", "other"), F.greatest("block", "other")).alias("unit"),
        "set_id", "component", "block",
    )


def _open_links(nodes: DataFrame, sets: DataFrame, texts: DataFrame, linked: DataFrame, percent: int) -> DataFrame:
    """``a``, ``b``: links that join the components of a node that are not one yet.

    Nodes within one component are done.  The sets of the others meet in units.
    """
    member = linked.select(F.col("node").alias("set_id"), "component")
    dealt = _units(nodes.join(member, "set_id", "left").withColumn("component", F.coalesce("component", "set_id")))
    tokens = sets.select("set_id", "tokens")
    rows = dealt.join(tokens, "set_id").select("unit", "set_id", "component", "block", "tokens")
    # only sets with a likely partner in another component carry their shingles to the unit
    likely = keep(rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _by_unit(lambda part: _partnered(part, percent)), "unit long, set_id long, component long, block int"
    ))
    full = texts.select("set_id", "text").mapInArrow(_whole_sets, "set_id long, shingles binary")
    rows = likely.join(full.join(tokens, "set_id"), "set_id").select(
        "unit", "set_id", "component", "block", "tokens", "shingles"
    )
    return rows.repartition("unit").sortWithinPartitions("unit").mapInArrow(
        _by_unit(lambda part: _across(part, percent)), "a long, b long"
    ).distinct()


def _by_unit(solve):
    """Applies solve to the rows of each unit; they come sorted by unit and go as soon as they are whole."""

    def run(batches):
        held = []
        for batch in _with_end(batches):
            if batch is not None:
                held += [batch.slice(i, 256) for i in range(0, batch.num_rows, 256)]
                if sum(b.num_rows for b in held) < 256:
                    continue
            if not held:
                continue
            table = pa.concat_batches(held)
            unit = np.asarray(table.column(0))
            ends = (np.flatnonzero(np.diff(unit)) + 1).tolist() + ([len(unit)] if batch is None else [])
            begin = 0
            for end in ends:
                found = solve(table.slice(begin, end - begin))
                if found is not None:
                    yield found
                begin = end
            held = [table.slice(begin)] if begin < len(unit) else []

    return run


def _with_end(batches):
    yield from batches
    yield None


def _other(i: int, group: np.ndarray, block: np.ndarray, one: bool) -> np.ndarray:
    """Later rows of a unit in another component; sets of one block meet in the unit of that block alone."""
    return np.flatnonzero((group[i + 1:] != group[i]) & (one | (block[i + 1:] != block[i]))) + i + 1


def _partnered(part: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """The rows of a unit that have a likely partner."""
    component, block = np.asarray(part.column(2)), np.asarray(part.column(3))
    if len(block) < 2 or (component == component[0]).all():
        return None
    one, enough, some = (block == block[0]).all(), least_equal(percent), np.zeros(len(block), bool)
    tokens = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).reshape(-1, COORDINATES)
    for i in range(len(block) - 1):
        j = _other(i, component, block, one)
        if len(j):
            j = j[(tokens[j] == tokens[i]).sum(1) >= enough]
            some[j] = True
            some[i] |= len(j) > 0
    return part.select([0, 1, 2, 3]).filter(pa.array(some)) if some.any() else None


def _across(part: pa.RecordBatch, percent: int) -> pa.RecordBatch | None:
    """Links of a unit that join components."""
    ids, component, block = (np.asarray(part.column(i)) for i in (1, 2, 3))
    a, b = [], []
    if len(ids) < 2:
        return None
    one, enough = (block == block[0]).all(), least_equal(percent)
    tokens = np.frombuffer(b"".join(part.column(4).to_pylist()), np.uint32).reshape(-1, COORDINATES)
    sets = [np.frombuffer(x, U) for x in part.column(5).to_pylist()]
    size = np.array(list(map(len, sets)))
    _, group = np.unique(component, return_inverse=True)
    for i in range(len(ids) - 1):
        j = _other(i, group, block, one)
        if len(j):
            j = j[(tokens[j] == tokens[i]).sum(1) >= enough]
        if not len(j):
            continue
        flat = np.concatenate([sets[x] for x in j])
        place = np.searchsorted(sets[i], flat)
        hit = sets[i][np.minimum(place, size[i] - 1)] == flat
        both = np.add.reduceat(hit, np.cumsum(size[j]) - size[j], dtype=np.int64)
        for x in j[100 * both >= percent * (size[i] + size[j] - both)]:
            if group[x] != group[i]:
                group[group == group[x]] = group[i]
                a.append(min(ids[i], ids[x]))
                b.append(max(ids[i], ids[x]))
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"]) if a else None


def linked(docs: DataFrame, percent: int = 85, trees: int = 12, depth: int = 3, small: int = 256) -> tuple[DataFrame, DataFrame]:
    """``doc_id``, ``n`` of every row, and ``node``, ``component`` of every document that is not the first of its own."""
    rows = keep(describe(docs))
    same = rows.where("n > 0").groupBy("h1", "h2", "n")
    sets = keep(same.agg(F.min("doc_id").alias("set_id"), F.first("tokens").alias("tokens")).select("set_id", "n", "tokens"))
    # stored, so that Spark sees both sizes and splits a group of very many equal sets
    several = keep_narrow(same.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).where("a < z").drop("z"))
    equal = rows.where("n > 0").join(several, ["h1", "h2", "n"]).select("a", F.col("doc_id").alias("b"))
    nodes = keep(_nodes(sets, percent, trees, depth, small))
    first = keep(_likely(_pivot_pairs(nodes), sets, percent))
    # texts of all sets that any pair can need
    near = nodes.select("set_id").distinct()
    texts = keep(
        docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("set_id"), "text")
        .join(near, "set_id", "left_semi")
    )
    # joins with texts: in as many tasks as the shuffle has, few links come out of each
    links = keep(_confirmed(first, texts, percent))
    links = links.unionByName(keep(_open_links(nodes, sets, texts, components(links), percent)))
    return rows, components(links.unionByName(equal))


def report(docs: DataFrame, **options) -> DataFrame:
    """Every document with its set size and component, ``kept`` for the first of each."""
    rows, members = linked(docs, **options)
    return rows.join(members.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"),
        F.col("component").isNull().alias("kept"),
    )


def apply(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """The documents without those that are not the first of their component; all columns as they are."""
    _, members = linked(docs, percent, **options)
    return docs.join(members.select(F.col("node").alias("doc_id")), "doc_id", "left_anti").select(*docs.columns)
