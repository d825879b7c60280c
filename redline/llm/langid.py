"""Language identification: multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three characters of the lower-cased text, every
other character than a letter being a blank, hashed to ``SIZE`` counts; their
document frequencies come from all labelled documents.  Weights are learnt by
follow-the-regularised-leader (per-coordinate steps, proximal L1 and L2), so most
stay zero, on a sample of about ``per_language`` documents of each language,
chosen by a hash of doc_id; one part in five of it is kept back to fit the
temperature that calibrates the probabilities.

Null texts and texts without a letter are ``und`` with score 0, and so is every
text if there is nothing to learn from.  A text of other letters gets the
likeliest language with a low score.  Equal probabilities: the first language in
order of name.  Rows with a null doc_id or null lang are not learnt from.  Only
doc_id, text and, to learn, lang are read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redline.llm.words import U, buffers, mix, slices

BITS = 14
SIZE = 1 << BITS
ROWS = 128  # of dense counts at a time: 16 MB


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def ngram_counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per group of rows: the first, its counts (rows x SIZE) and which rows have a letter."""
    at, _ = buffers(texts)
    for i, j in slices(at):
        for a in range(i, j, ROWS):
            some = [(t or "").lower() for t in texts.slice(a, min(ROWS, j - a)).to_pylist()]
            code = np.frombuffer("\n".join([" ", *some, " "]).encode("utf-32-le", "replace"), np.uint32)
            size = np.array([len(t) + 1 for t in some])
            row = np.repeat(np.arange(len(some)), size)
            letter = _letters()[code]
            code = np.where(letter, code, 32).astype(U)
            n = len(row)
            hashed, total = np.zeros(n, U), np.zeros((len(some), SIZE), np.float64)
            for k in range(3):  # the run that ends at each character and the one before the text
                hashed = hashed * U(0x9E3779B97F4A7C15) + code[2 - k:2 - k + n] + U(1)
                feature = (mix(hashed + U(k)) >> U(64 - BITS)).astype(np.int64)
                total += np.bincount(row * SIZE + feature, minlength=total.size).reshape(total.shape)
            seen = np.bincount(row, letter[2:2 + n], minlength=len(some)) > 0
            yield a, total, seen


class Model:
    def __init__(self, labels: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.labels, self.idf, self.weights, self.bias, self.temperature = labels, idf, weights, bias, temperature
        self.scaled = weights * idf[:, None]

    def predict(self, texts: pa.Array) -> tuple[list[str], np.ndarray]:
        names, scores = [], [np.zeros(0)]
        for _, counts, seen in ngram_counts(texts):
            if not self.labels:
                names += ["und"] * len(counts)
                scores.append(np.zeros(len(counts)))
                continue
            norm = np.sqrt(np.square(counts) @ np.square(self.idf))
            logits = (counts @ self.scaled) / np.maximum(norm, 1e-12)[:, None] + self.bias
            p = _softmax(logits / self.temperature)
            best = p.argmax(1)
            names += [self.labels[k] if s else "und" for k, s in zip(best, seen)]
            scores.append(np.where(seen, p[np.arange(len(p)), best], 0.0))
        return names, np.concatenate(scores)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train_ftrl(rows, n_labels: int, epochs: int, alpha=0.5, beta=1.0, l1=0.02, l2=0.02) -> tuple[np.ndarray, np.ndarray]:
    """rows: (places, values, label); gives weights (SIZE x labels) and bias."""
    z, n = np.zeros((SIZE + 1, n_labels)), np.zeros((SIZE + 1, n_labels))

    def leader(at):
        zi, ni = z[at], n[at]
        shrunk = np.sign(zi) * np.maximum(np.abs(zi) - l1, 0)
        return -shrunk / ((beta + np.sqrt(ni)) / alpha + l2)

    for _ in range(epochs):
        for places, values, label in rows:
            at = np.append(places, SIZE)
            x = np.append(values, 1.0)
            w = leader(at)
            error = _softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            square = g * g
            z[at] += g - (np.sqrt(n[at] + square) - np.sqrt(n[at])) / alpha * w
            n[at] += square
    w = leader(np.arange(SIZE + 1))
    return w[:SIZE], w[SIZE]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least log loss, on a grid of ratios of 5 %."""
    if not len(labels):
        return 1.0
    grid = 1.05 ** np.arange(-80, 81)
    loss = [-np.log(np.maximum(_softmax(logits / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(loss))])


def train(docs: DataFrame, per_language: int = 1500, epochs: int = 3) -> Model:
    """Learns from rows with doc_id, text and lang; the sample is about ``per_language`` rows a language."""
    labelled = docs.where("doc_id IS NOT NULL AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "text", "lang")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().collect()}  # one row a language
    labels = sorted(sizes)
    if not labels:
        return Model([], np.ones(SIZE), np.zeros((SIZE, 0)), np.zeros(0), 1.0)

    def frequencies(batches):
        df = np.zeros(SIZE, np.int64)
        for batch in batches:
            for _, counts, _ in ngram_counts(batch.column(0)):
                df += (counts > 0).sum(0)
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(df[some])], names=["feature", "n"])

    df = np.zeros(SIZE)
    for r in labelled.select("text").mapInArrow(frequencies, "feature long, n long").groupBy("feature").sum("n").collect():
        df[r[0]] = r[1]  # SIZE rows at most
    idf = np.log((1 + sum(sizes.values())) / (1 + df)) + 1

    def vectors(batches):
        for batch in batches:
            names = batch.column(1).to_pylist()
            for first, counts, seen in ngram_counts(batch.column(0)):
                x = counts * idf
                norm = np.maximum(np.sqrt(np.square(x).sum(1)), 1e-12)
                places = [np.flatnonzero(c) for c in counts]
                yield pa.RecordBatch.from_arrays([
                    batch.column(2).slice(first, len(counts)), pa.array(names[first:first + len(counts)]),
                    pa.array(places, pa.list_(pa.int32())),
                    pa.array([x[i, p] / norm[i] for i, p in enumerate(places)], pa.list_(pa.float32())),
                ], names=["h", "lang", "places", "x"])

    rate = F.lit(0.0)
    for name, n in sizes.items():
        rate = F.when(F.col("lang") == name, F.lit(min(1.0, per_language / n))).otherwise(rate)
    h = F.xxhash64("doc_id")
    chosen = labelled.withColumn("h", h).where(F.pmod("h", F.lit(1_000_003)) < rate * 1_000_003)
    sample = chosen.select("text", "lang", "h").mapInArrow(
        vectors, "h long, lang string, places array<int>, x array<float>"
    )

    def learn(batches):
        rows, kept_back = [], []
        for batch in batches:
            for key, name, places, x in zip(*(c.to_pylist() for c in batch.columns)):
                row = (key, np.array(places, np.int64), np.array(x, np.float64), labels.index(name))
                (kept_back if key // 1_000_003 % 5 == 0 else rows).append(row)
        rows.sort(key=lambda r: r[0] % 999_983)  # an order that does not depend on the partitions
        w, bias = train_ftrl([r[1:] for r in rows], len(labels), epochs)
        logits = np.array([x @ w[p] + bias for _, p, x, _ in kept_back]).reshape(-1, len(labels))
        t = fit_temperature(logits, np.array([r[3] for r in kept_back], np.int64))
        out = io.BytesIO()
        np.savez_compressed(out, w=w.astype(np.float32), bias=bias, t=t)
        yield pa.RecordBatch.from_arrays([pa.array([out.getvalue()], pa.binary())], names=["model"])

    got = np.load(io.BytesIO(sample.repartition(1).mapInArrow(learn, "model binary").first()[0]))
    return Model(labels, idf, got["w"].astype(np.float64), got["bias"], float(got["t"]))


def held_out(doc_id="doc_id"):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``lang_pred``, ``score`` of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            names, scores = shared.value.predict(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores)], names=["doc_id", "lang_pred", "score"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, "doc_id long, lang_pred string, score double"
    )


def report(docs: DataFrame) -> DataFrame:
    """Every document with its language, learnt from those that are not held out."""
    model = train(docs.where(~held_out()))
    return predict(docs, model).select(
        "doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score"
    )


def apply(docs: DataFrame, least: float = 0.3) -> DataFrame:
    """The documents whose language is clear: not ``und`` and a score of ``least`` or more; all columns as they are."""
    model = train(docs.where(~held_out()))
    shared, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def clear(batches):
        for batch in batches:
            _, scores = shared.value.predict(batch.column(at))
            yield batch.filter(pa.array((scores > 0) & (scores >= least)))

    return docs.mapInArrow(clear, docs.schema)
