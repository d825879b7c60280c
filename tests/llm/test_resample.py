"""Importance resampling against brute force."""

import hashlib
import math
import random
import re
import string
import zlib

import numpy as np
import pyarrow as pa
import pytest

from redline.llm import resample

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def features(text, n=2):
    w = WORD.findall((text or "").translate(FOLD))
    return w, [" ".join(w[i:i + k]) for k in range(1, n + 1) for i in range(len(w) - k + 1)]


def brute(docs, target, percent=25, least=20, n=2):
    def buckets(rows):
        count = [0] * 10000
        for t in rows:
            for f in features(t, n)[1]:
                count[zlib.crc32(f.encode()) % 10000] += 1
        return count

    s, t = buckets(t for _, t in docs), buckets(target)
    gain = [math.floor(1000 * math.log((b + 1) * (sum(s) + 10000) / ((a + 1) * (sum(t) + 10000)))) for a, b in zip(s, t)]
    rows = []
    for doc_id, text in docs:
        w, f = features(text, n)
        weight = sum(gain[zlib.crc32(x.encode()) % 10000] for x in f) // len(f) if f else 0
        score = None
        if doc_id is not None:
            h = int(hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(f), weight, score, None, len(w) >= least])
    able = sorted((r for r in rows if r[5] and r[0] is not None), key=lambda r: (-r[3], r[0], -r[1], -r[2]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.fixture(scope="module")
def corpus(word_list, awkward):
    r = random.Random(9)
    rows = [(i, " ".join(r.choices(word_list[:400], k=r.randint(5, 60))).title()) for i in range(400)]
    rows += [(d + 1000 if d else d, t) for d, t in awkward]
    rows += [(2000, " ".join(word_list[:30]))] * 5 + [(2000, " ".join(word_list[:25]))] * 3  # one doc_id, two texts
    target = [" ".join(r.choices(word_list[:60], k=40)) for _ in range(20)] + [None, ""]
    return rows, target


def got(df):
    assert df.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    return sorted(map(tuple, df.collect()), key=repr)


def test_draw_equals_brute_force(spark, make_docs, corpus):
    rows, target = corpus
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample.report(make_docs(rows), bench)) == brute(rows, target)


@pytest.mark.parametrize("percent", [0, 99])
def test_every_share(spark, make_docs, corpus, percent):
    rows, target = corpus
    bench = spark.createDataFrame([(t,) for t in target], "text string")
    assert got(resample.report(make_docs(rows), bench, percent=percent)) == brute(rows, target, percent)


def test_a_sketch_that_misses_is_widened(spark):
    """A coarse sketch over few different scores, so that the bracket has to grow; ties fill it."""
    r = random.Random(1)
    rows = [(i, r.choice([5, 5, 5, 6, 900]), 10, 0) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, score long, n_features long, weight long")
    want = sorted(rows, key=lambda x: (-x[1], x[0]))
    for k in (1, 2, 600, 1500, 2999, 3000):
        score, doc_id, _, _ = resample.cutoff(df, k, accuracy=200)
        assert (score, doc_id) == (want[k - 1][1], want[k - 1][0])


def test_crcs_of_joined_words():
    r = random.Random(2)
    texts = ["".join(r.choices(string.ascii_lowercase + "é深", k=r.choice([1, 2, 9, 31, 33, 200, 5000]))) for _ in range(300)]
    text = " ".join(texts)
    for n in (1, 2, 3):
        _, _, _, found = next(resample.features(pa.array([text]), n, (1 << 32) - 1))
        assert sorted(found.tolist()) == sorted(zlib.crc32(f.encode()) % ((1 << 32) - 1) for f in features(text, n)[1])


def test_empty_tables(spark, make_docs):
    none = spark.createDataFrame([], "text string")
    assert resample.report(make_docs([]), none).collect() == []
    assert got(resample.report(make_docs([(1, None), (2, "a b")]), none)) == brute([(1, None), (2, "a b")], [])
    assert (resample.gains(np.zeros(10000, int), np.zeros(10000, int)) == 0).all()
