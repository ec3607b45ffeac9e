"""Text quality by a factorisation machine.

Features of a whole text: hashed words and word shapes (weighted by the logarithm
of their counts), statistics of its structure (share of capitals, punctuation and
digits, word length, repetition, lines) and metadata of the row itself (its length).
Labels, language, source and id are never features. Pairs of features interact by
the inner product of low-rank factors; the sum over all pairs takes linear time:
half of (square of the sum - sum of the squares) for each factor.

The model is fitted in numpy on at most `sample_rows` labelled training rows (those
whose crc32 of the id, mod 4, is not 2), picked by a hash of the id, and is then
broadcast (a few MB, fixed by the number of buckets). Scores are probabilities.

Null and empty texts have no words; they get the score of an empty feature set.
Null labels and ids aren't learnt from; a null id isn't held out. Without any
labels of both kinds all scores are the share of label 1 (0.5 without labels).
Repeated rows are scored each; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, is_training_row, labelled_sample, slices
from .words import MOST_WORDS, Vocabulary, bare, bucket, shape

WORD_BUCKETS, SHAPE_BUCKETS, FACTORS = 1 << 16, 1 << 12, 8
STATISTICS, BINS = 14, 10
FIRST_VALUE = WORD_BUCKETS + SHAPE_BUCKETS
FIRST_BIN = FIRST_VALUE + STATISTICS
FEATURES = FIRST_BIN + STATISTICS * BINS


def describe(words: list[str]) -> tuple[np.ndarray, ...]:
    """Buckets and counts of characters by kind of each word."""
    buckets = np.array([(bucket(bare(w), WORD_BUCKETS), WORD_BUCKETS + bucket(shape(w), SHAPE_BUCKETS, 1)) for w in words], np.int64).reshape(-1, 2)
    kinds = []
    for w in words:
        if w.isalpha():
            upper, alpha, digit = 0 if w.islower() else sum(map(str.isupper, w)), len(w), 0
        else:
            upper, alpha, digit = sum(map(str.isupper, w)), sum(map(str.isalpha, w)), sum(map(str.isdigit, w))
        other = len(w) - alpha - digit
        kinds.append((len(w), upper, alpha, digit, other, alpha > 1 and upper == alpha, not w[-1].isalnum() and w[-1] not in ".,", other == len(w)))
    return buckets, np.array(kinds, np.float32).reshape(-1, 8)


def by_text(values: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sums over the words of each text; ends: number of words up to each text's end."""
    starts = np.r_[0, ends[:-1]]
    out, some = np.zeros((len(ends), *values.shape[1:])), np.flatnonzero(ends > starts)
    if len(some):
        out[some] = np.add.reduceat(values, starts[some], axis=0, dtype=np.float64)
    return out


@dataclass
class Sparse:
    """Rows of features: row i holds entries start[i]:start[i + 1]."""

    start: np.ndarray
    feature: np.ndarray
    value: np.ndarray


class Featurizer:
    def __init__(self, most_words: int = MOST_WORDS):
        self.vocabulary = Vocabulary(describe, most_words)

    def raw(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, bucket, log count) of the words and shapes, and the statistics of each row."""
        split = [t.split() for t in texts]
        ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        n = np.diff(np.r_[0, ends])
        rows = self.vocabulary.rows([w for own in split for w in own])
        buckets, kinds = self.vocabulary.tables
        text_of = np.repeat(np.arange(len(texts)), n)
        keys, counts = np.unique(np.concatenate([text_of << 20 | buckets[rows, k] for k in (0, 1)]), return_counts=True)
        row, feature, value = keys >> 20, keys & ((1 << 20) - 1), np.log1p(counts)
        chars, upper, alpha, digit, other, shouted, odd_end, no_letters = by_text(kinds[rows], ends).T
        is_word = feature < WORD_BUCKETS
        distinct = np.bincount(row[is_word], minlength=len(texts))
        top = np.zeros(len(texts))
        np.maximum.at(top, row[is_word], counts[is_word])
        same = np.r_[False, (rows[1:] == rows[:-1]) & (text_of[1:] == text_of[:-1])].astype(np.float64) if len(rows) else np.zeros(0)
        some, letters, signs = np.maximum(n, 1), np.maximum(alpha, 1), np.maximum(chars, 1)
        lines = np.array([t.count("\n") + 1 for t in texts])
        length = np.array([len(t) for t in texts])
        statistics = np.c_[
            np.log1p(n), chars / some, upper / letters, digit / signs, other / signs, shouted / some, odd_end / some, no_letters / some,
            distinct / some, top / some, by_text(same, ends) / some, np.log1p(lines), n / lines, np.log1p(length),
        ]
        return row, feature, value, statistics

    def rows(self, texts: list[str], scales: np.ndarray, edges: np.ndarray) -> Sparse:
        return sparse(self.raw(texts), scales, edges)


def sparse(raw: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], scales: np.ndarray, edges: np.ndarray) -> Sparse:
    """All features of the rows: words and shapes at unit length, statistics as values and as bins."""
    row, feature, value, statistics = raw
    n = len(statistics)
    norm = np.sqrt(np.bincount(row, value**2, n))
    value = value / np.maximum(norm, 1e-9)[row]
    centred = np.clip((statistics - scales[0]) / scales[1], -4, 4) * 0.25
    which = np.stack([np.searchsorted(edges[:, k], statistics[:, k], "right") for k in range(STATISTICS)], axis=1)
    own = np.repeat(np.arange(n), STATISTICS)
    row = np.concatenate([row, own, own])
    feature = np.concatenate([feature, np.tile(FIRST_VALUE + np.arange(STATISTICS), n), (FIRST_BIN + np.arange(STATISTICS) * BINS + which).ravel()])
    value = np.concatenate([value, centred.ravel(), np.full(len(own), 0.5)])
    by = np.argsort(row, kind="stable")
    return Sparse(np.searchsorted(row[by], np.arange(n + 1)), feature[by], value[by].astype(np.float32))


@dataclass
class Machine:
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    scales: np.ndarray
    edges: np.ndarray

    def margin(self, s: Sparse) -> np.ndarray:
        x = s.value[:, None]
        v = self.factors[s.feature] * x
        add = lambda a: np.add.reduceat(np.r_[a, np.zeros((1, *a.shape[1:]), a.dtype)], s.start[:-1]) * (np.diff(s.start) > 0).reshape(-1, *[1] * (a.ndim - 1))
        return self.bias + add(self.weights[s.feature] * s.value) + 0.5 * (add(v) ** 2 - add(v * v)).sum(axis=1)


def fit(texts: list[str], labels: np.ndarray, epochs: int = 8, rate: float = 0.08, shrink: float = 2e-5, batch: int = 64) -> Machine:
    """Adagrad on the logistic loss."""
    featurizer = Featurizer(5 * MOST_WORDS)
    raws = [featurizer.raw(texts[i : i + 500]) for i in range(0, len(texts), 500)]
    statistics = np.concatenate([r[3] for r in raws]) if texts else np.zeros((1, STATISTICS))
    scales = np.stack([statistics.mean(axis=0), statistics.std(axis=0) + 1e-6])
    edges = np.quantile(statistics, np.linspace(0, 1, BINS + 1)[1:-1], axis=0)
    rng = np.random.default_rng(3)
    share = float(np.clip(labels.mean(), 0.01, 0.99)) if len(labels) else 0.5
    m = Machine(float(np.log(share / (1 - share))), np.zeros(FEATURES, np.float32), rng.normal(0, 0.02, (FEATURES, FACTORS)).astype(np.float32), scales, edges)
    if len(set(labels.tolist())) < 2:
        m.factors[:] = 0
        return m
    parts = [sparse(r, scales, edges) for r in raws]
    shift = np.cumsum([0, *(len(p.feature) for p in parts)])
    s = Sparse(np.r_[np.concatenate([p.start[:-1] + k for p, k in zip(parts, shift, strict=False)]), shift[-1]], np.concatenate([p.feature for p in parts]), np.concatenate([p.value for p in parts]))
    squares_w, squares_v, square_b = np.full(FEATURES, 1e-4, np.float32), np.full((FEATURES, FACTORS), 1e-4, np.float32), 1e-4
    for _ in range(epochs):
        order = rng.permutation(len(texts))
        for at in range(0, len(order), batch):
            own = order[at : at + batch]
            n = s.start[own + 1] - s.start[own]
            entries = np.repeat(s.start[own] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())
            f, x, of = s.feature[entries], s.value[entries], np.repeat(np.arange(len(own)), n)
            z = m.margin(Sparse(np.r_[0, np.cumsum(n)], f, x))
            g = (1 / (1 + np.exp(-z)) - labels[own]).astype(np.float32) / len(own)
            v = m.factors[f] * x[:, None]
            sums = np.zeros((len(own), FACTORS), np.float32)
            np.add.at(sums, of, v)
            gx = g[of] * x
            ids, back = np.unique(f, return_inverse=True)
            gw, gv = np.bincount(back, gx, len(ids)).astype(np.float32), np.zeros((len(ids), FACTORS), np.float32)
            np.add.at(gv, back, gx[:, None] * (sums[of] - v))
            gw += shrink * m.weights[ids]
            gv += shrink * m.factors[ids]
            squares_w[ids] += gw**2
            squares_v[ids] += gv**2
            m.weights[ids] -= rate * gw / np.sqrt(squares_w[ids])
            m.factors[ids] -= rate * gv / np.sqrt(squares_v[ids])
            square_b += float(g.sum()) ** 2
            m.bias -= rate * float(g.sum()) / square_b**0.5
    return m


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = 6_000) -> Machine:
    """Fits on a sample of labelled training rows; its bound bounds what reaches the driver."""
    rows = labelled_sample(docs, labels, label, sample_rows).select("doc_id", "text", "_label").toPandas().sort_values(["doc_id"], kind="stable")
    return fit([t or "" for t in rows["text"]], rows["_label"].to_numpy(np.float32))


def score(docs: DataFrame, machine: Machine, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted (1 if score >= threshold, else 0) of each row of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, featurizer = shared.value, Featurizer()
        for b in slices(batches, "text"):
            z = m.margin(featurizer.rows([t or "" for t in b.column("text").to_pylist()], m.scales, m.edges))
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("held_out", F.coalesce(~is_training_row(), F.lit(False)))
    return arrow_map(rows, run, "doc_id long, held_out boolean, score double, predicted int")


def without_rejected(docs: DataFrame, machine: Machine, threshold: float = 0.5) -> DataFrame:
    """The rows of docs whose score reaches the threshold, all columns as they were."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, featurizer = shared.value, Featurizer()
        for b in slices(batches, "text"):
            yield b.filter(pa.array(m.margin(featurizer.rows([t or "" for t in b.column("text").to_pylist()], m.scales, m.edges)) >= np.log(threshold / (1 - threshold))))

    return arrow_map(docs, run, docs.schema)


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, sample_rows: int = 6_000) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of docs."""
    return score(docs, train(docs, labels, sample_rows=sample_rows), threshold)
