"""Operator 9: text quality by hashed word n-gram logistic regression.

Features are hashed n-grams of words (one and two) and of word shapes (one to
three): a word's case, digits, length class and whether it repeats the word
before it; other characters are words of their own.  A text's value of a feature
is its share of the text's n-grams, so scoring is one sparse dot product per text
whatever its length.

The model is fitted on a bounded sample of labelled rows that are not held out
(labelled.py) by follow-the-regularised-leader updates (FTRL-proximal, McMahan et
al. 2013), one text at a time in a fixed order, and is sent to the tasks: 2**BITS
weights.  Every whole text is scored in one scan without a shuffle.

Edges: a null or empty text has no features and gets the score of the bias;
without labelled rows of both classes every score is that class's label, or 1
where there are none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.llm import labelled, tables, words

BITS = 18
SCALE = 30.0
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.5, 3
_U = np.uint64
_MASK = _U((1 << BITS) - 1)
_KIND = np.zeros(256, np.uint8)  # 0 space, 1 word, 2 other
_KIND[33:] = 2
_KIND[np.r_[0x30:0x3A, 0x41:0x5B, 0x61:0x7B, 0x80:0x100]] = 1
_KIND[127] = 0
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_UPPER = np.zeros(256, bool)
_UPPER[0x41:0x5B] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[0x30:0x3A] = True


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places of features, the text of each, the number of features of each text)."""
    array = np.frombuffer(b"\n".join(texts), np.uint8)
    kind = _KIND[array]
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])[: len(texts)]
    opens = kind > 0
    opens[1:] &= (kind[1:] == 2) | (kind[:-1] != 1)
    starts = np.flatnonzero(opens)
    if not len(starts):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(len(texts), np.int64)
    closes = kind > 0
    closes[:-1] &= (kind[:-1] == 2) | (kind[1:] != 1)
    ends = np.flatnonzero(closes) + 1
    doc = np.searchsorted(begins, starts, side="right") - 1
    word = words.hashes(_LOWER[array], starts, ends)
    length = ends - starts
    upper = np.cumsum(np.append(0, _UPPER[array]))
    n_upper = upper[ends] - upper[starts]
    digit = np.cumsum(np.append(0, _DIGIT[array]))
    has_digit = digit[ends] > digit[starts]
    same = np.zeros(len(word), bool)
    same[1:] = word[1:] == word[:-1]
    case = np.where(n_upper == 0, 0, np.where(n_upper == length, 2, np.where(_UPPER[array[starts]], 1, 3)))
    size = np.minimum(length, 24) // 4
    shape = np.where(kind[starts] == 2, array[starts].astype(np.int64), 256 + case * 64 + has_digit * 32 + same * 16 + size)
    shape = words.scrambled(shape.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + _U(1))
    places, docs = [], []
    for x, most, salt in ((word, 2, 11), (shape, 3, 23)):
        for n in range(1, most + 1):
            g = words.scrambled(words.grams(x, n) + _U(salt * n)) if len(x) >= n else np.empty(0, np.uint64)
            inside = doc[: len(g)] == doc[n - 1 :] if len(g) else np.empty(0, bool)
            places.append((g[inside] & _MASK).astype(np.int64))
            docs.append(doc[: len(g)][inside])
    place, of = np.concatenate(places), np.concatenate(docs)
    return place, of, np.bincount(of, minlength=len(texts))


class Model:
    """Weights and bias; score() of texts is in 0 to 1."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), bias

    def score(self, texts: list[bytes]) -> np.ndarray:
        out = np.empty(len(texts))
        for a, b in words.chunks(texts):
            place, of, n = features(texts[a:b])
            total = np.bincount(of, weights=self.weights[place], minlength=b - a)
            z = self.bias + SCALE * total / np.maximum(n, 1)
            out[a:b] = 1 / (1 + np.exp(-np.clip(z, -35, 35)))
        return out


def fit(texts: list[bytes], labels: list[int]) -> Model:
    """FTRL-proximal over the texts in order, EPOCHS times."""
    size = 1 << BITS
    if len(set(labels)) < 2:
        return Model(np.zeros(size), 35.0 * (1 if not labels or labels[0] else -1))
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    rows = []
    for t in texts:
        place, _, count = features([t])
        at, times = np.unique(place, return_counts=True)
        rows.append((np.append(at, size), np.append(SCALE * times / max(1, int(count[0])), 1.0)))

    def weights(z: np.ndarray, n: np.ndarray, l1: np.ndarray | float) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    order = np.random.RandomState(7)
    for _ in range(EPOCHS):
        for i in order.permutation(len(rows)):
            at, x = rows[i]
            w = weights(z[at], n[at], L1)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -35, 35)))
            g = (p - labels[i]) * x
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - sigma * w
            n[at] += g * g
    w = weights(z, n, L1)
    return Model(w[:size], float(w[size]))


def model(docs: DataFrame, labels: DataFrame) -> Model:
    """The classifier fitted on the bounded sample."""
    return fit(*labelled.sample(docs, labels, "quality"))


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score and predicted, of every row of documents."""
    return scored(docs, model(docs, labels).score, threshold)


def accepted(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose text scores ``threshold`` or more, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            yield batch.filter(pa.array(model.score(texts) >= threshold))

    rows = tables.named(docs, "text")
    return rows.mapInArrow(run, rows.schema).toDF(*docs.columns)


def scored(docs: DataFrame, score, threshold: float) -> DataFrame:
    """One scan: ``score`` maps a list of texts to numbers from 0 to 1."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in words.small(batches):
            s = score(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    rows = tables.named(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), (labelled.fold() == 0).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
