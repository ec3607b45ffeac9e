"""Toxicity of texts by a convolutional classifier, trained in numpy.

A word is the sum of the hashed embeddings of its bare form and its beginnings,
so that unseen endings still share what was learnt. Filters over 1, 2 and 3 words
run over the whole text; the largest value of each filter (max pooling) enters a
logistic output. A filter's response to a word in a given place is made once for
each distinct word, so a text costs additions only.

Trained on all labelled training rows (crc32 of the id, mod 4, not 2). Their words are turned into numbers once, in
blocks of texts that are written as a table. Every partition of blocks, a shard of about `shard_rows` rows, trains networks that start
alike, and the shards' networks are averaged; small tables are gone through several times, from `LEAST_STEPS` rows on once. One shard alone is
gone through in its task, so the driver gets its networks once, not after each pass. Beside the final network
each shard trains one for each fold, without the fold's rows, so every labelled row gets a score by a network that hasn't
seen it; counts of these scores, rounded to 1/BINS of log-odds, calibrate the final network's (a line on the log-odds) and a decision threshold for each language with
enough positives. The language column only picks that threshold; the score comes
from the text alone. The model has a fixed size and is broadcast. The first dimension
of an embedding starts as the log-odds of the label given the word, counted over all rows, as a
naive Bayes classifier has them; README gives the accuracy with and without it.

Null and empty texts have no words; the pooled values are zero and so the score is
low. Null labels and ids aren't learnt from; a null id isn't held out; a null or
unknown language gets the common threshold. Without labels of both kinds all scores
are the share of label 1 (0 without labels). Repeated rows are scored each; extra
columns are ignored.
"""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest as digest

from .common import arrow_map, discard, is_training_row, labelled_rows, materialize, slices
from .words import Vocabulary, bare

BUCKETS, DIMENSIONS, FILTERS, WIDTHS = 1 << 16, 8, 8, (1, 2, 3)
BEGINNINGS = (3, 4, 5, 6)
N_PARTS = 1 + len(BEGINNINGS)
#: Places over all widths; the response of a filter to a word depends on the place.
PLACES = [(w, k) for w in WIDTHS for k in range(w)]
#: Labelled positives a language needs for a threshold of its own.
LEAST_POSITIVES = 15
#: Passes over a table are as many as make so many rows, at least one and at most six.
LEAST_STEPS, MOST_PASSES = 48_000, 6
#: Parts of a unit of log-odds that scores are counted by, and the log-odds at which they are cut off.
BINS, MOST_ODDS = 256, 64
#: Numbers of a model or of counts that are summed up in one group.
CHUNK = 1 << 15


def parts(words: list[str]) -> tuple[np.ndarray, ...]:
    """Buckets of the bare word and of its beginnings; bucket 0 holds zeros and stands for no such beginning."""
    bares = [bare(w) for w in words]
    lengths = np.fromiter(map(len, bares), np.int64, len(bares))
    out = np.zeros((len(bares), N_PARTS), np.int64)
    for i, k in enumerate((0, *BEGINNINGS)):
        own = [b[: k or None] for b in bares if len(b) > k]
        out[lengths > k, i] = 1 + np.fromiter((digest(b, k) for b in own), np.uint64, len(own)) % (BUCKETS - 1)
    return (out,)


@dataclass
class Network:
    embeddings: np.ndarray
    kernels: np.ndarray  # place, dimension, filter
    shifts: np.ndarray  # width, filter
    weights: np.ndarray  # width * filter
    bias: float
    line: tuple[float, float] = (1.0, 0.0)
    thresholds: dict = field(default_factory=dict)

    def responses(self, vectors: np.ndarray) -> np.ndarray:
        """(words, places * filters)"""
        return vectors @ self.kernels.transpose(1, 0, 2).reshape(DIMENSIONS, -1)

    def convolve(self, responses: np.ndarray, rows: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Pooled values (text, width * filter), and for each width the responses at all places and their largest by text."""
        starts = np.r_[0, ends[:-1]]
        pooled, where, n = [], [], len(rows)
        for i, w in enumerate(WIDTHS):
            columns = [PLACES.index((w, k)) * FILTERS for k in range(w)]
            top, largest, value = np.zeros((len(ends), FILTERS), np.float32), np.full((len(ends), FILTERS), np.inf, np.float32), np.zeros((0, FILTERS), np.float32)
            if n >= w:
                value = responses[rows[: n - w + 1], columns[0] : columns[0] + FILTERS]
                for k in range(1, w):
                    value = value + responses[rows[k : n - w + 1 + k], columns[k] : columns[k] + FILTERS]
                # Windows that leave their text don't count.
                last = ends - (w - 1)
                some = np.flatnonzero(last > starts)
                if len(some):
                    cut = np.stack([starts[some], last[some]], axis=1).ravel()
                    cut = cut[cut < len(value)]
                    largest[some] = np.maximum.reduceat(value, cut, axis=0)[::2]
                    top[some] = np.maximum(largest[some] + self.shifts[i], 0)
            where.append((value, largest))
            pooled.append(top)
        return np.concatenate(pooled, axis=1), where

    def logits(self, pooled: np.ndarray) -> np.ndarray:
        return pooled @ self.weights + self.bias


@dataclass
class Block:
    """Texts as numbers: `words` are the parts of each distinct word, `rows` the texts' words in a row, `ends` where each text ends."""

    words: np.ndarray
    rows: np.ndarray
    ends: np.ndarray
    labels: np.ndarray
    folds: np.ndarray
    langs: list

    def of(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words and ends of some of the texts."""
        starts = np.r_[0, self.ends[:-1]]
        return np.concatenate([self.rows[starts[i] : self.ends[i]] for i in own]).astype(np.int64), np.cumsum((self.ends - starts)[own])


def block_of(texts: list[str], labels: np.ndarray, folds: np.ndarray, langs: list) -> Block:
    ids: dict[str, int] = {}
    split = [t.split() for t in texts]
    rows = np.fromiter((ids.setdefault(w, len(ids)) for own in split for w in own), np.uint32)
    return Block(parts(list(ids))[0].astype(np.uint16), rows, np.cumsum([len(w) for w in split], dtype=np.int64), np.asarray(labels, np.float32), np.asarray(folds, np.uint8), langs)


def count(block: Block, seen: np.ndarray) -> None:
    """Adds the texts that hold each bucket to seen (fold, label, bucket); bucket 0, that of no word, holds the number of texts."""
    starts = np.r_[0, block.ends[:-1]]
    for i, (y, fold) in enumerate(zip(block.labels, block.folds, strict=True)):
        held = np.unique(block.words[np.unique(block.rows[starts[i] : block.ends[i]])])
        seen[fold, int(y), held] += 1
        seen[fold, int(y), 0] += 0 if len(held) and held[0] == 0 else 1


def first_embeddings(seen: np.ndarray, rng: np.random.Generator, planted: bool = True) -> np.ndarray:
    """Small random values; the first dimension starts as the smoothed log-odds of the label given the bucket, unless not planted."""
    n = seen[:, 0]
    odds = np.log((seen[1] + 0.5) / (n[1] + 1)) - np.log((seen[0] + 0.5) / (n[0] + 1))
    e = rng.normal(0, 0.05, (BUCKETS, DIMENSIONS)).astype(np.float32)
    if planted:
        e[:, 0] = np.where(seen.sum(axis=0) >= 2, 0.15 * odds, 0)
    e[0] = 0
    return e


class Learner:
    """A network and the sums of squares of its gradients (Adagrad on the logistic loss)."""

    def __init__(self, seen: np.ndarray, planted: bool = True):
        """seen: texts by label and bucket. Without labels of both kinds the network is constant."""
        rng = np.random.default_rng(17)
        n = seen[:, 0]
        share = float(np.clip(n[1] / n.sum(), 1e-6, 1 - 1e-6)) if n.sum() else 1e-6
        self.net = net = Network(
            np.zeros((BUCKETS, DIMENSIONS), np.float32), rng.normal(0, 0.3, (len(PLACES), DIMENSIONS, FILTERS)).astype(np.float32), np.zeros((len(WIDTHS), FILTERS), np.float32),
            rng.uniform(0.2, 0.5, len(WIDTHS) * FILTERS).astype(np.float32), float(np.log(share / (1 - share))),
        )
        self.constant = not n.all()
        if self.constant:
            net.weights[:] = 0
        else:
            net.kernels[:, 0, : FILTERS // 2] = np.abs(net.kernels[:, 0, : FILTERS // 2]) + 0.5
            net.embeddings = first_embeddings(seen, rng, planted)
        self.squares, self.square_e, self.square_b = [np.full_like(a, 1e-3) for a in (net.kernels, net.shifts, net.weights)], np.full_like(net.embeddings, 1e-3), 1e-3

    def numbers(self, whole: bool) -> np.ndarray:
        """The network's numbers in a row; the whole learner's, to learn on, have the sums of squares, too."""
        net = self.net
        own = [net.embeddings, net.kernels, net.shifts, net.weights, np.array([net.bias])]
        return np.concatenate([a.ravel() for a in (own + [self.square_e, *self.squares, np.array([self.square_b])] if whole else own)])

    def take(self, numbers: np.ndarray) -> None:
        """Either kind of numbers."""
        net, at = self.net, 0

        def fill(arrays: list[np.ndarray]) -> float:
            """Fills the arrays; gives the number after them."""
            nonlocal at
            for a in arrays:
                a[...] = numbers[at : at + a.size].reshape(a.shape)
                at += a.size
            at += 1
            return float(numbers[at - 1])

        net.bias = fill([net.embeddings, net.kernels, net.shifts, net.weights])
        if at < len(numbers):
            self.square_b = fill([self.square_e, *self.squares])

    def through(self, block: Block, own: np.ndarray, rng: np.random.Generator, batch: int = 32) -> None:
        """One pass over some texts of the block, in a drawn order."""
        if not self.constant:
            own = own[rng.permutation(len(own))]
            for at in range(0, len(own), batch):
                self.learn(block, own[at : at + batch])

    def learn(self, block: Block, own: np.ndarray, rate: float = 0.05) -> None:
        """Only the words at the pooled places get a gradient."""
        net = self.net
        rows, ends = block.of(own)
        uniques, rows = np.unique(rows, return_inverse=True)
        of_word = block.words[uniques]
        vectors = net.embeddings[of_word].sum(axis=1)
        pooled, where = net.convolve(net.responses(vectors), rows, ends)
        g = (1 / (1 + np.exp(-net.logits(pooled))) - block.labels[own]).astype(np.float32) / len(own)
        g_weights = pooled.T @ g + 1e-4 * net.weights
        g_pooled = (g[:, None] * net.weights) * (pooled > 0)
        g_kernels, g_shifts, g_words = np.zeros_like(net.kernels), np.zeros_like(net.shifts), np.zeros_like(vectors)
        text_of = np.repeat(np.arange(len(own)), np.diff(np.r_[0, ends]))
        for i, w in enumerate(WIDTHS):
            value, largest = where[i]
            gp = g_pooled[:, i * FILTERS : (i + 1) * FILTERS]
            of = text_of[: len(value)]
            inside = np.arange(len(value)) <= ends[of] - w
            place, f = np.nonzero((value == np.where(gp != 0, largest, np.inf)[of]) & inside[:, None])
            # The first place of each text and filter with a gradient.
            _, first = np.unique(of[place] * FILTERS + f, return_index=True)
            place, f = place[first], f[first]
            gradient = gp[of[place], f]
            by_filter = np.zeros((len(f), FILTERS), np.float32)
            by_filter[np.arange(len(f)), f] = gradient
            g_shifts[i] += by_filter.sum(axis=0)
            for k in range(w):
                p, word = PLACES.index((w, k)), rows[place + k]
                g_kernels[p] += vectors[word].T @ by_filter
                np.add.at(g_words, word, net.kernels[p][:, f].T * gradient[:, None])
        touched = np.flatnonzero(np.abs(g_words).sum(axis=1))
        ids, back = np.unique(of_word[touched].ravel(), return_inverse=True)
        g_e = np.zeros((len(ids), DIMENSIONS), np.float32)
        np.add.at(g_e, back, np.repeat(g_words[touched], N_PARTS, axis=0))
        self.square_e[ids] += g_e**2
        net.embeddings[ids] -= rate * g_e / np.sqrt(self.square_e[ids])
        net.embeddings[0] = 0
        for a, s, ga in zip((net.kernels, net.shifts, net.weights), self.squares, (g_kernels, g_shifts, g_weights), strict=True):
            s += ga**2
            a -= rate * ga / np.sqrt(s)
        self.square_b += float(g.sum()) ** 2
        net.bias -= rate * float(g.sum()) / self.square_b**0.5


class Scorer:
    def __init__(self, net: Network):
        self.net = net
        self.vocabulary = Vocabulary(self.describe)

    def describe(self, words: list[str]) -> tuple[np.ndarray, ...]:
        return (self.net.responses(self.net.embeddings[parts(words)[0]].sum(axis=1)),)

    def margins(self, texts: list[str]) -> np.ndarray:
        """Log-odds before calibration."""
        split = [t.split() for t in texts]
        rows = self.vocabulary.rows([w for own in split for w in own])
        ends = np.cumsum([len(w) for w in split], dtype=np.int64)
        return self.net.logits(self.net.convolve(self.vocabulary.tables[0], rows, ends)[0])

    def scores(self, texts: list[str]) -> np.ndarray:
        a, b = self.net.line
        return 1 / (1 + np.exp(-np.clip(a * self.margins(texts) + b, -30, 30)))


def calibrated_line(margins: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> tuple[float, float]:
    """Slope and shift that make the logistic of the margins fit the labels (Newton steps with a small prior); counts: rows of each."""
    a, b = 1.0, 0.0
    c = np.ones(len(margins)) if counts is None else counts
    positive, total = (c * labels).sum(), c.sum()
    y = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (total - positive + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        w, r = c * (p * (1 - p) + 1e-9), c * (p - y)
        g = np.array([(r * margins).sum() + 0.1 * (a - 1), r.sum() + 0.1 * b])
        h = np.array([[(w * margins**2).sum() + 0.1, (w * margins).sum()], [(w * margins).sum(), w.sum() + 0.1]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
    return (max(a, 1e-3), b)


def best_threshold(scores: np.ndarray, labels: np.ndarray, counts: np.ndarray | None = None) -> float:
    """The threshold of the highest F1, in the middle of its gap; counts: rows of each."""
    c = np.ones(len(scores)) if counts is None else counts
    s, of = np.unique(scores, return_inverse=True)
    cuts = np.r_[0.0, (s[1:] + s[:-1]) / 2, 1.0]
    # Rows, and those of label 1, from each cut on; none from the last on.
    above, found = (np.r_[np.cumsum(np.bincount(of, w, len(s))[::-1])[::-1], 0] for w in (c, c * labels))
    f1 = 2 * found / np.maximum(1, above + found[0])
    top = np.flatnonzero(f1 == f1.max())
    return float(cuts[top[len(top) // 2]])


def blocks_of(rows: DataFrame, folds: int) -> DataFrame:
    """The labelled rows as pickled blocks of some 500 KB of text, with their number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            made = block_of([t or "" for t in b.column("text").to_pylist()], *(b.column(c).to_numpy(zero_copy_only=False) for c in ("_label", "fold")), b.column("lang").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64()), pa.array([pickle.dumps(made)], pa.binary())], ["n", "block"])

    fold = F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(folds)).cast("int").alias("fold")
    return arrow_map(rows.select("text", (F.col("_label") == 1).cast("int").alias("_label"), "lang", fold), run, "n long, block binary")


def unpickled(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
    for b in batches:
        for x in b.column("block"):
            yield pickle.loads(x.as_buffer())


def passes(batches: Iterator[pa.RecordBatch], turns: range) -> Iterator[tuple[int, Block]]:
    """Each turn with each block. For more turns than one the blocks stay in a temporary file, not in memory."""
    with tempfile.TemporaryFile() as kept:
        for b in batches:
            for x in b.column("block"):
                if len(turns) > 1:
                    kept.write(x.as_buffer())
                yield turns[0], pickle.loads(x.as_buffer())
        end = kept.tell()
        for turn in turns[1:]:
            kept.seek(0)
            while kept.tell() < end:
                yield turn, pickle.load(kept)


CHUNKS = "k int, chunk int, weight double, numbers binary"


def chunked(k: int, weight: float, numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
    for i, at in enumerate(range(0, len(numbers), CHUNK)):
        yield pa.RecordBatch.from_arrays(
            [pa.array([k], pa.int32()), pa.array([i], pa.int32()), pa.array([weight], pa.float64()), pa.array([numbers[at : at + CHUNK].astype(np.float32).tobytes()])], ["k", "chunk", "weight", "numbers"]
        )


def combined(rows: DataFrame, mean: bool) -> dict[int, np.ndarray]:
    """Sums, or means by weight (these in single precision), of the numbers of each k, added up by chunks on Spark. As many numbers as a few models hold."""
    kind = np.float32 if mean else np.float64

    def add(table: pa.Table) -> pa.Table:
        weights, total = table.column("weight").to_pylist(), 0.0
        for w, x in zip(weights, table.column("numbers"), strict=True):
            total = total + w * np.frombuffer(x.as_buffer(), np.float32).astype(np.float64)
        out = (total / sum(weights) if mean else total).astype(kind).tobytes()
        return pa.table({"k": table.column("k").slice(0, 1), "chunk": table.column("chunk").slice(0, 1), "weight": pa.array([sum(weights)]), "numbers": pa.array([out], pa.binary())})

    found: dict[int, list] = {}
    for r in sorted(rows.groupBy("k", "chunk").applyInArrow(add, CHUNKS).select("k", "chunk", "numbers").collect()):
        found.setdefault(r.k, []).append(np.frombuffer(r.numbers, kind))
    return {k: np.concatenate(own) for k, own in found.items()}


def learners_of(seen: np.ndarray, numbers: dict[int, np.ndarray] | None = None) -> list[Learner]:
    """A learner without each fold, and the last with all rows; seen: texts by fold, label and bucket; numbers: what they have learnt so far."""
    out = [Learner(seen.sum(axis=0) - own) for own in seen] + [Learner(seen.sum(axis=0))]
    for k, own in (numbers or {}).items():
        out[k].take(own)
    return out


def passes_of(rows: float) -> int:
    return int(np.clip(LEAST_STEPS // max(1, rows), 1, MOST_PASSES))


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", folds: int = 4, shard_rows: int = 24_000) -> Network:
    """Learns from all labelled training rows; what reaches the driver is counts and models, of a size that doesn't depend on the rows."""
    spark = docs.sparkSession
    blocks = materialize(blocks_of(labelled_rows(docs, labels, label), folds), "blocks")

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((folds, 2, BUCKETS))
        for block in unpickled(batches):
            count(block, seen)
        if seen.any():
            yield from chunked(0, 1.0, seen.ravel())

    seen = combined(arrow_map(blocks, counts, CHUNKS), mean=False).get(0, np.zeros(folds * 2 * BUCKETS)).reshape(folds, 2, BUCKETS)
    rows, first = seen[:, :, 0].sum(), Learner(seen.sum(axis=0))
    if first.constant:
        discard(blocks)
        return first.net
    shards, times, numbers = int(np.ceil(rows / shard_rows)), passes_of(rows), None
    # One shard has nothing to be averaged with, so its task makes all passes.
    for turns in [range(times)] if shards == 1 else [range(i, i + 1) for i in range(times)]:
        # Learners start from the counts, which are much smaller than they are.
        shared = spark.sparkContext.broadcast((seen, numbers))

        def learn(batches: Iterator[pa.RecordBatch], shared=shared, turns=turns) -> Iterator[pa.RecordBatch]:
            own, rngs, n = learners_of(*shared.value), [np.random.default_rng(17 + turn) for turn in range(times)], 0
            for turn, block in passes(batches, turns):
                n += len(block.ends)
                for k, learner in enumerate(own):
                    learner.through(block, np.flatnonzero(block.folds != k), rngs[turn])
            for k, learner in enumerate(own):
                if n:
                    yield from chunked(k, n, learner.numbers(whole=turns[-1] < times - 1))

        # Blocks are dealt in turn, so shards are about equal.
        numbers = combined(arrow_map(blocks.repartition(shards), learn, CHUNKS), mean=True)
        shared.destroy()
    learners = learners_of(seen, numbers)
    shared = spark.sparkContext.broadcast([x.net for x in learners[:-1]])

    def aside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in unpickled(batches):
            bins = np.rint(out_of_fold(shared.value, block) * BINS).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(block.langs, pa.string()), pa.array(bins), pa.array(block.labels.astype(np.int64))], ["lang", "bin", "y"])

    told = materialize(arrow_map(blocks, aside, "lang string, bin long, y long").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin", "y").agg(F.count("*").alias("n")), "scores")
    enough = told.groupBy("lang").agg(F.sum(F.col("y") * F.col("n")).alias("positives")).where(F.col("positives") >= LEAST_POSITIVES)
    bins = lambda rows: rows.groupBy("lang", "bin", "y").agg(F.sum("n").alias("n")).toPandas().sort_values(["lang", "bin", "y"])
    every, own = bins(told.withColumn("lang", F.lit(""))), bins(told.join(enough, "lang", "left_semi"))
    net = calibrated(learners[-1].net, every, {lang: r for lang, r in own.groupby("lang")})
    shared.destroy()
    discard(blocks, told)
    return net


def out_of_fold(nets: list[Network], block: Block) -> np.ndarray:
    """Each text's log-odds by the network that was trained without its fold, cut off at MOST_ODDS; nets: that of each fold."""
    out = np.zeros(len(block.ends))
    for k, net in enumerate(nets):
        own = np.flatnonzero(block.folds == k)
        if len(own):
            rows, ends = block.of(own)
            uniques, rows = np.unique(rows, return_inverse=True)
            out[own] = net.logits(net.convolve(net.responses(net.embeddings[block.words[uniques]].sum(axis=1)), rows, ends)[0])
    return np.clip(out, -MOST_ODDS, MOST_ODDS)


def train_on(texts: list[str], y: np.ndarray, langs: list, folds: int = 4) -> Network:
    """As train, in one process."""
    block, seen = block_of(texts, y, np.random.default_rng(29).integers(0, folds, len(texts)), langs), np.zeros((folds, 2, BUCKETS))
    count(block, seen)
    learners, rng = learners_of(seen), np.random.default_rng(17)
    if learners[-1].constant:
        return learners[-1].net
    for _ in range(passes_of(len(texts))):
        for k, learner in enumerate(learners):
            learner.through(block, np.flatnonzero(block.folds != k), rng)
    bins = np.rint(out_of_fold([x.net for x in learners[:-1]], block) * BINS)
    rows = pd.DataFrame({"lang": [x or "" for x in langs], "bin": bins, "y": block.labels, "n": 1})
    return calibrated(learners[-1].net, rows, {x: own for x, own in rows.groupby("lang") if own.y.sum() >= LEAST_POSITIVES})


def calibrated(net: Network, rows: pd.DataFrame, by_lang: dict[str, pd.DataFrame]) -> Network:
    """The network with a line on its log-odds and thresholds; rows: number n of label y by bin of the log-odds out of fold."""
    columns = lambda r: (r["bin"].to_numpy(np.float64) / BINS, r["y"].to_numpy(np.float64), r["n"].to_numpy(np.float64))
    net.line = calibrated_line(*columns(rows))

    def threshold(r: pd.DataFrame) -> float:
        z, y, n = columns(r)
        return best_threshold(1 / (1 + np.exp(-np.clip(net.line[0] * z + net.line[1], -30, 30))), y, n)

    net.thresholds = {x: threshold(own) for x, own in by_lang.items()} | {"": threshold(rows)}
    return net


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted (score >= threshold), threshold and flagged (by the language's own threshold)."""
    net = train(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(net)
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = shared.value
        scorer = Scorer(net)
        for b in slices(batches, "text"):
            p = scorer.scores([t or "" for t in b.column("text").to_pylist()])
            own = np.array([net.thresholds.get(x or "", net.thresholds.get("", threshold)) for x in b.column("lang").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("held_out"), pa.array(p, pa.float64()), pa.array(p >= threshold).cast(pa.int32()), pa.array(own, pa.float64()), pa.array(p >= own)],
                ["doc_id", "held_out", "score", "predicted", "threshold", "flagged"],
            )

    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))
    ids = ids.withColumn("held_out", F.coalesce(~is_training_row(), F.lit(False)))
    return arrow_map(ids, run, "doc_id long, held_out boolean, score double, predicted int, threshold double, flagged boolean")
