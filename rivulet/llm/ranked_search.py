"""Ranked lexical search over a length-stratified index.

Documents of equal length normaliser m form a stratum. In each stratum a term's postings are
grouped by tf, so what a term adds is computed once for each tf and not for each document. The
highest tf of each term bounds what a stratum's documents can score; an item visits the strata in the
order of their bounds and stops where a bound lies below the score of its k-th document.

Two passes: the first turns the texts into counts of the items' terms and writes these few numbers a
document; statistics of the collection come from them on Spark. The second reads them, indexes a
bounded number of postings at a time and keeps each item's k best as it goes through a partition; the
best of all partitions are ranked by item. No postings are cut, nothing is grouped by term.

Terms are maximal runs of ASCII letters and digits and all characters beyond ASCII; only A-Z is
put in lower case. Null and empty texts have no terms and count nowhere. Documents and items
without an id take no part. Rows that repeat a document's id are documents of their own, each with
its score; rows that repeat an item's id are one item with the terms of all. Ties go to the smaller
doc_id. Other columns are ignored. Empty tables give an empty table. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_map, discard, materialize, slices

#: Items whose terms are looked for in one pass over the texts; more items take more passes.
ITEMS = 2_000
#: Postings that a task indexes at a time.
POSTINGS = 1_000_000

#: Bytes of UTF-8 that stay, in lower case, and those that part terms. Bytes from 0x80 on are parts of characters beyond ASCII.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def terms_of(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split(b" ") if text else []


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2.0 * n_docs + 2) / (2.0 * df + 1)))


def impact(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 20 * m)


def term_counts(docs: DataFrame, terms: list[bytes]) -> DataFrame:
    """doc_id, n (terms with repeats) and, of `terms`, those that a document holds (by their numbers, ascending) and how often. Documents without any term go."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shared.value
        for b in slices(batches, "text"):
            ids, ns, held, tfs = [], [], [], []
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                found = Counter(terms_of(text or ""))
                found.pop(b"", None)
                if not found:
                    continue
                own = sorted((numbers[t], found[t]) for t in found.keys() & numbers.keys())
                ids.append(doc_id)
                ns.append(sum(found.values()))
                held.append([t for t, _ in own])
                tfs.append([c for _, c in own])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(ns, pa.int64()), pa.array(held, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int64()))], ["doc_id", "n", "terms", "tfs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    return arrow_map(rows, run, "doc_id long, n long, terms array<int>, tfs array<long>")


class Strata:
    """The index of some documents: postings by stratum, term and tf."""

    def __init__(self, ids: np.ndarray, m: np.ndarray, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, n_terms: int):
        """sizes: number of postings of each document; terms and tfs: those of all documents in a row."""
        order = np.lexsort((ids, m))
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        #: Documents by stratum, then id: of equal scores the first wins.
        self.ids, m = ids[order], m[order]
        self.m, self.first = np.unique(m, return_index=True)
        self.end = np.r_[self.first[1:], len(ids)]
        doc = np.repeat(place, sizes)
        stratum = np.searchsorted(self.m, m)[doc]
        by = np.lexsort((doc, tfs, terms, stratum))
        stratum, terms, tfs, self.doc = stratum[by], terms[by], tfs[by], doc[by]
        # Runs of equal stratum, term and tf, whose impact is computed once.
        new = np.r_[True, (stratum[1:] != stratum[:-1]) | (terms[1:] != terms[:-1]) | (tfs[1:] != tfs[:-1])] if len(by) else np.zeros(0, bool)
        self.run = np.flatnonzero(new)
        self.run_impact = impact(tfs[self.run], self.m[stratum[self.run]])
        self.run_end = np.r_[self.run[1:], len(by)]
        # Cells of a stratum and a term: their runs, of which the last has the highest tf.
        cell = stratum[self.run] * n_terms + terms[self.run]
        self.cell_first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]]) if len(cell) else np.zeros(0, np.int64)
        self.cell, self.cell_end = cell[self.cell_first], np.r_[self.cell_first[1:], len(cell)]
        # For bounds, the cells by term: each with its stratum and the impact of its highest tf.
        by_term = np.argsort(self.cell % n_terms, kind="stable")
        self.term_first = np.searchsorted((self.cell % n_terms)[by_term], np.arange(n_terms + 1))
        self.term_stratum, self.term_most = self.cell[by_term] // n_terms, self.run_impact[self.cell_end - 1][by_term]
        self.n_terms = n_terms

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """What each stratum's documents can score at most; sums of integers below 2**53, so exact."""
        first, end = self.term_first[terms], self.term_first[terms + 1]
        cells = spread(first, end)
        return np.bincount(self.term_stratum[cells], self.term_most[cells] * np.repeat(weights, end - first).astype(np.float64), len(self.m))

    def score(self, s: int, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the documents of stratum s that hold some of the terms, by id."""
        cells = np.searchsorted(self.cell, s * self.n_terms + terms)
        there = cells < len(self.cell)
        there[there] = self.cell[cells[there]] == (s * self.n_terms + terms)[there]
        cells, weights = cells[there], weights[there]
        runs = spread(self.cell_first[cells], self.cell_end[cells])
        adds = self.run_impact[runs] * np.repeat(weights, self.cell_end[cells] - self.cell_first[cells])
        places = self.doc[spread(self.run[runs], self.run_end[runs])] - self.first[s]
        total = np.bincount(places, np.repeat(adds, self.run_end[runs] - self.run[runs]).astype(np.float64), self.end[s] - self.first[s])
        hit = np.flatnonzero(total > 0)
        return self.ids[self.first[s] + hit], total[hit].astype(np.int64)


def spread(first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    n = end - first
    return np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)


class Best:
    """The k best documents of an item so far: highest score first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        return int(self.scores[-1]) if len(self.scores) == self.k else 0

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        good = scores >= max(self.least, 1)
        if good.any():
            ids, scores = np.r_[self.ids, ids[good]], np.r_[self.scores, scores[good]]
            top = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[top], scores[top]


def search(index: Strata, items: dict[int, tuple[np.ndarray, np.ndarray]], best: dict[int, Best]) -> None:
    """Puts the index's documents into the items' best, stratum by stratum in the order of their bounds."""
    for item, (terms, weights) in items.items():
        bounds, own = index.bounds(terms, weights), best[item]
        for s in np.argsort(-bounds, kind="stable"):
            if bounds[s] <= 0 or bounds[s] < own.least:
                break
            own.add(*index.score(s, terms, weights))


def best_of_partitions(counts: DataFrame, items: dict[int, list[int]], weights: np.ndarray, n_docs: int, length: int, k: int) -> DataFrame:
    """item_id, doc_id, score: each partition's k best for each item."""
    of = {item: (np.array(terms, np.int64), weights[terms]) for item, terms in items.items()}
    shared = counts.sparkSession.sparkContext.broadcast(of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, held, size = shared.value, [], 0
        best = {item: Best(k) for item in of}

        def index() -> None:
            ids, n, sizes, terms, tfs = (np.concatenate(x) for x in zip(*held, strict=True))
            search(Strata(ids, 50 + (50 * n * n_docs) // length, sizes, terms, tfs, len(weights)), of, best)

        for b in batches:
            lists, tfs = b.column("terms"), b.column("tfs")
            sizes = np.diff(lists.offsets.to_numpy())
            held.append((b.column("doc_id").to_numpy(), b.column("n").to_numpy(), sizes, lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()))
            size += int(sizes.sum())
            if size >= POSTINGS:
                index()
                held, size = [], 0
        if held:
            index()
        sizes = [len(own.ids) for own in best.values()]
        columns = [np.repeat(np.array(list(best), np.int64), sizes), *(np.concatenate([np.zeros(0, np.int64), *(getattr(own, c) for own in best.values())]) for c in ("ids", "scores"))]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["item_id", "doc_id", "score"])

    # Documents without any of the terms can't score.
    return arrow_map(counts.where(F.size("terms") > 0), run, "item_id long, doc_id long, score long")


def ranked(rows: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("item_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: each item's k highest-scoring documents with a score above 0."""
    asked = items.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).cast("string").alias("text")).where("item_id is not null and text is not null")
    passes = max(1, math.ceil(asked.select("item_id").distinct().count() / ITEMS))
    found = []
    for p in range(passes):
        # The items of a pass: ITEMS or so, whatever their number. Their terms are broadcast.
        terms_by_item: dict[int, set[bytes]] = {}
        for row in asked.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == p).toLocalIterator():
            terms_by_item.setdefault(row.item_id, set()).update(t for t in terms_of(row.text) if t)
        terms = sorted(set().union(*terms_by_item.values()))
        numbers = {t: i for i, t in enumerate(terms)}
        counts = materialize(term_counts(docs, terms), "term-counts")
        total = counts.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        df = np.zeros(len(terms), np.int64)
        for row in counts.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
            df[row.t] = row["count"]
        weights = np.array([term_weight(total.docs, int(x)) for x in df], np.int64)
        own = {item: [numbers[t] for t in sorted(ts)] for item, ts in terms_by_item.items() if ts}
        rows = materialize(best_of_partitions(counts, own, weights, total.docs, max(1, total.length), k), "ranked-parts")
        discard(counts)
        found.append(rows)
    return ranked(reduce(DataFrame.unionByName, found), k)
