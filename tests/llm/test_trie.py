"""Prefix trie against brute force."""

import hashlib
import math
import random
import zlib
from collections import defaultdict

import pytest

from redline.llm import convtrie

SCHEMA = "conv_id long, turn long, role string, text string"


def said(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()


def sequences(rows, rebuild=True):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append(((t is not None, t or 0), said(role, text), role or "", text or ""))
    turns = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    if not rebuild:
        return turns
    out = {}
    for c in turns:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(math.fmod(c, 5))  # remainders as in SQL
        out[c] = turns.get(base, [])[:h] + turns[c][h:]
    return out


def brute(seqs):
    members = defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[tuple(s[:d])].append(c)
    kids = defaultdict(set)
    for node in members:
        if node:
            kids[node[:-1]].add(node)
    out = []
    for node, m in members.items():
        subtree = [x for x in members if x[:len(node)] == node]
        ends = ",".join(map(str, sorted(c for c in m if len(seqs[c]) == len(node))))
        out.append((
            min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids[node]),
            sum(not kids[x] for x in subtree), sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in subtree if x),
            hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def trie(spark, rows, rebuild=True, **options):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS node", "1 AS n", "2 AS depth", "3 AS part", "4 AS place")
    got = convtrie.trie(*(convtrie.rebuilt(df) if rebuild else convtrie.numbered(df)), **options)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(map(tuple, got.collect()), key=repr)


@pytest.fixture(scope="module")
def talks():
    r = random.Random(5)
    lines = ["", "hello", "grüße", "what now", "深い", None, "a longer answer to it"]
    rows = []
    for c in range(90):
        if c in (7, 35, 40):
            continue  # absent bases too
        for t in range(r.choice([1, 1, 2, 3, 5, 12])):
            rows.append((c, t, r.choice(["user", None, "assistant"]), r.choice(lines[:2 + t % 6])))
    for c in range(200, 260):  # copies, some with a turn more
        rows += [(c, t, "user", f"copy {t}") for t in range(11 + (c % 7 == 0))]
    rows += [(300, None, "user", "no number"), (300, None, "user", "no number"), (300, 0, "x", "y"), (300, 0, "x", "a")]
    rows += [(None, 1, "user", "nobody"), (-3, 0, "user", "below"), (-5, 0, "user", "below"), (10**15, 1, "user", "far")]
    rows += [(400, t, "user", str(t % 3)) for t in range(60)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("options", [{}, {"block": 3, "listed": 2}])
def test_trie_equals_brute_force(spark, talks, options):
    assert trie(spark, talks, **options) == brute(sequences(talks))


def test_plain_conversations(spark, talks):
    assert trie(spark, talks, rebuild=False, block=4) == brute(sequences(talks, rebuild=False))


def test_places_do_not_depend_on_the_ranges(spark, talks):
    df = spark.createDataFrame(talks, SCHEMA).repartition(7)
    places, lengths = convtrie.numbered(df)
    want = sequences(talks, rebuild=False)
    got = defaultdict(list)
    for x in places.orderBy("conv_id", "place").collect():
        got[x.conv_id].append((x.place, bytes(x.said).hex()))
    assert got == {c: [(i + 1, said(*x)) for i, x in enumerate(s)] for c, s in want.items()}
    assert {x.conv_id: x.n for x in lengths.collect()} == {c: len(s) for c, s in want.items()}


def test_end_lists_come_in_pieces(spark):
    df = spark.createDataFrame([(c, 0, "user", "same") for c in range(25)], SCHEMA)
    places, lengths = convtrie.numbered(df)
    ends, weighted = convtrie.collapse(convtrie.prefixes(places, lengths), lengths)
    lists = convtrie.end_lists(ends, 4).orderBy("first").collect()
    assert ",".join(x.ids for x in lists) == ",".join(map(str, range(25))) and max(len(x.ids.split(",")) for x in lists) <= 4
    assert [(x.seq, x.weight) for x in weighted.collect()] == [(0, 25)]


def test_a_turnless_table_and_a_turnless_root(spark):
    assert trie(spark, []) == []
    # 1 has fewer turns than it gives up, and no conversation to take them from
    assert zlib.crc32(b"1") % 9 > 1
    rows = [(1, 0, "user", "gone")]
    assert trie(spark, rows) == brute(sequences(rows)) == [(1, 0, None, 1, 0, 1, 0, hashlib.sha256(b"1").hexdigest())]
