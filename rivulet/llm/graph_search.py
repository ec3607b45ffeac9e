"""Approximate nearest neighbours by inner product: a robust-pruned directed graph for each shard.

A shard's graph grows by batches: a greedy beam search on the graph so far proposes
neighbours of each new vector; relaxed distance pruning keeps a proposal only if no
kept neighbour is nearer to it by the factor `alpha`, so that edges stay few and
diverse; edges back are added and pruned alike. The graphs are written as a table.
Queries search every shard's graph by beam search, streamed past the graph; the best of
all shards are ranked by the inner product of the original vectors in double precision.
Shards grow with the table, within `shard_rows`, as each costs every query a search.

Inner products become distances by one more component that gives all vectors of a
shard one length. Equal vectors of a shard are one node, which holds its smallest
ids: more than k of them can't be among k results.

Vectors that are null, zero or hold null or non-finite components take no part;
vectors of another length than the query's aren't candidates; repeated rows count
once; a query with fewer candidates than k gets all that are found. Extra columns
are ignored; empty tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .kd_search import matrix
from .vectors import best, dealt, every, usable

#: Edges of a node, beam while building and relaxation of the pruning.
DEGREE, BUILD_BEAM, ALPHA = 32, 64, 1.2
#: New vectors searched at once, candidates expanded at once for each, and marks of seen nodes that a search holds.
BATCH, EXPAND, SEEN = 1024, 4, 1 << 24
#: Tasks of a search; beyond it a task takes several groups in turn.
MOST_TASKS = 20_000


def lengthened(x: np.ndarray, longest: float) -> np.ndarray:
    """Scaled to lengths up to 1, with a component that makes the length 1."""
    x = x / longest
    return np.c_[x, np.sqrt(np.maximum(0, 1 - (x * x).sum(axis=1)))].astype(np.float32)


def beam_search(x: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes (-1: none) and squared distances of the nearest found for each query, nearest first."""
    n, m = len(x), len(queries)
    nodes, dist = np.full((m, beam), -1, np.int64), np.full((m, beam), np.inf, np.float32)
    done = np.ones((m, beam), bool)
    seen = np.zeros((m, n), bool)
    nodes[:, 0], dist[:, 0], done[:, 0] = start, ((queries - x[start]) ** 2).sum(axis=1), False
    seen[:, start] = True
    active = np.arange(m)
    while len(active):
        order = np.cumsum(~done[active], axis=1)
        pick = ~done[active] & (order <= EXPAND)
        r, c = np.nonzero(pick)
        rows = active[r]
        done[rows, c] = True
        near = graph[nodes[rows, c]]
        pairs = (rows[:, None] * n + near)[near >= 0]
        pairs = np.unique(pairs[~seen.ravel()[pairs]])
        seen.ravel()[pairs] = True
        q, v = pairs // n, pairs % n
        gap = x[v] - queries[q]
        d = np.einsum("ij,ij->i", gap, gap)
        keep = d < dist[q, -1]
        q, v, d = q[keep], v[keep], d[keep]
        if len(q):
            place = np.arange(len(q)) - np.searchsorted(q, q)
            width = int(place.max()) + 1
            own, back = np.unique(q, return_inverse=True)
            more_v, more_d = np.full((len(own), width), -1, np.int64), np.full((len(own), width), np.inf, np.float32)
            more_v[back, place], more_d[back, place] = v, d
            all_d = np.c_[dist[own], more_d]
            best_at = np.argsort(all_d, axis=1, kind="stable")[:, :beam]
            dist[own] = np.take_along_axis(all_d, best_at, 1)
            nodes[own] = np.take_along_axis(np.c_[nodes[own], more_v], best_at, 1)
            done[own] = np.take_along_axis(np.c_[done[own], more_v < 0], best_at, 1)
        active = active[(~done[active]).any(axis=1)]
    return nodes, dist


def robust_prune(x: np.ndarray, points: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Up to DEGREE neighbours of each point out of its candidates (-1: none); rows may repeat candidates."""
    out = np.full((len(points), DEGREE), -1, np.int64)
    for at in range(0, len(points), 256):
        p, c = points[at : at + 256], candidates[at : at + 256]
        vectors = x[np.maximum(c, 0)]
        gap = vectors - x[p][:, None, :]
        d = np.where((c < 0) | (c == p[:, None]), np.inf, np.einsum("ijk,ijk->ij", gap, gap))
        order = np.argsort(d, axis=1, kind="stable")
        d, c, vectors = np.take_along_axis(d, order, 1), np.take_along_axis(c, order, 1), np.take_along_axis(vectors, order[:, :, None], 1)
        square = np.einsum("ijk,ijk->ij", vectors, vectors)
        between = square[:, :, None] + square[:, None, :] - 2 * (vectors @ vectors.transpose(0, 2, 1))
        alive, kept = np.isfinite(d), np.zeros(len(p), np.int64)
        for j in range(c.shape[1]):
            take = np.flatnonzero(alive[:, j] & (kept < DEGREE))
            if not len(take):
                continue
            out[at + take, kept[take]] = c[take, j]
            kept[take] += 1
            alive[take] &= ALPHA**2 * between[take, j] > d[take]
            alive[take] &= c[take] != c[take, j][:, None]
    return out


def build(x: np.ndarray) -> tuple[np.ndarray, int]:
    """Neighbours of each node (-1: none) and the node where searches start."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    order = np.random.default_rng(5).permutation(n)
    start = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    order = np.r_[start, order[order != start]]
    done = min(n, 128)
    first = order[:done]
    graph[first] = robust_prune(x, first, np.repeat(first[None, :], done, 0))
    while done < n:
        new = order[done : done + min(BATCH, done, max(64, SEEN // n))]
        graph[new] = robust_prune(x, new, beam_search(x, graph, start, x[new], BUILD_BEAM)[0])
        # Edges back: to each neighbour its nearest new sources, pruned where they are too many.
        v, p = graph[new].ravel(), np.repeat(new, DEGREE)
        v, p = v[v >= 0], p[v >= 0]
        gap = x[v] - x[p]
        by = np.lexsort((np.einsum("ij,ij->i", gap, gap), v))
        v, p = v[by], p[by]
        near = np.arange(len(v)) - np.searchsorted(v, v) < DEGREE
        v, p = v[near], p[near]
        place = np.arange(len(v)) - np.searchsorted(v, v)
        own, back = np.unique(v, return_inverse=True)
        more = np.full((len(own), int(place.max(initial=0)) + 1), -1, np.int64)
        more[back, place] = p
        both = np.c_[graph[own], more]
        few = (both >= 0).sum(axis=1) <= DEGREE
        both = np.take_along_axis(both, np.argsort(both < 0, axis=1, kind="stable"), 1)
        graph[own[few]] = both[few, :DEGREE]
        if (~few).any():
            graph[own[~few]] = robust_prune(x, own[~few], both[~few])
        done += len(new)
    return graph, start


NODE = "dim int, shard int, node int, entry boolean, vector array<double>, ids array<long>, neighbours array<int>"
RESULT = "query_id long, vec_id long, score double"


def graphs(rows: DataFrame, k: int) -> DataFrame:
    """One row for each node of each shard's graph; rows: vec_id, vector, dim, shard."""

    def run(key: tuple, t: pa.Table) -> pa.Table:
        vectors, back = np.unique(matrix(t, "vector"), axis=0, return_inverse=True)
        ids = t.column("vec_id").to_numpy()
        by = np.lexsort((ids, back.ravel()))
        ends = np.cumsum(np.bincount(back.ravel()))
        members = [ids[by[s:e]][: k + 1] for s, e in zip(np.r_[0, ends[:-1]], ends, strict=True)]
        longest = float(np.sqrt((vectors / np.abs(vectors).max()) ** 2 @ np.ones(vectors.shape[1])).max() * np.abs(vectors).max())
        graph, start = build(lengthened(vectors, longest))
        n = len(vectors)
        return pa.table(
            {
                "dim": pa.array([key[0].as_py()] * n, pa.int32()),
                "shard": pa.array([key[1].as_py()] * n, pa.int32()),
                "node": pa.array(np.arange(n), pa.int32()),
                "entry": pa.array(np.arange(n) == start),
                "vector": pa.array(list(vectors), pa.list_(pa.float64())),
                "ids": pa.array(members, pa.list_(pa.int64())),
                "neighbours": pa.array([g[g >= 0] for g in graph.astype(np.int32)], pa.list_(pa.int32())),
            }
        )

    return rows.groupBy("dim", "shard").applyInArrow(run, NODE)


class Graph:
    """One shard's graph, read from its rows, in double precision and as the unit vectors that it is searched by."""

    def __init__(self, t: pa.Table):
        t = t.sort_by("node")
        self.vectors = matrix(t, "vector")
        largest = np.abs(self.vectors).max()
        self.unit = lengthened(self.vectors, float(np.linalg.norm(self.vectors / largest, axis=1).max() * largest))
        links = t.column("neighbours").combine_chunks()
        lengths = links.value_lengths().to_numpy(zero_copy_only=False)
        self.links = np.full((len(self.unit), DEGREE), -1, np.int64)
        self.links[np.arange(DEGREE)[None, :] < lengths[:, None]] = links.flatten().to_numpy(zero_copy_only=False)
        self.start = int(np.flatnonzero(t.column("entry").to_numpy(zero_copy_only=False))[0])
        ids = t.column("ids").combine_chunks()
        self.ids, self.ends = ids.flatten().to_numpy(), np.r_[0, np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query_id, vec_id and score of up to k nearest found of each query."""
        unit = queries / np.abs(queries).max(axis=1, keepdims=True)
        unit = np.c_[unit / np.linalg.norm(unit, axis=1, keepdims=True), np.zeros(len(queries))].astype(np.float32)
        out_q, out_v, out_s = [], [], []
        step = max(64, min(BATCH, SEEN // len(self.unit)))
        for at in range(0, len(queries), step):
            nodes = beam_search(self.unit, self.links, self.start, unit[at : at + step], beam)[0]
            for query_id, q, own in zip(query_ids[at : at + step].tolist(), queries[at : at + step], nodes, strict=True):
                own = own[own >= 0]
                got = np.concatenate([self.ids[self.ends[i] : self.ends[i + 1]] for i in own])
                scores = np.repeat(self.vectors[own] @ q, self.ends[own + 1] - self.ends[own])
                ok = got != query_id
                got, scores = got[ok], scores[ok]
                top = np.lexsort((got, -scores))[:k]
                out_q.append(np.full(len(top), query_id))
                out_v.append(got[top])
                out_s.append(scores[top])
        return tuple(np.concatenate(x) for x in (out_q, out_v, out_s))


#: Takes the place of the node's number in a query's row, so that queries follow their shard's nodes.
QUERY = (1 << 31) - 1


def searched(index: DataFrame, queries: DataFrame, k: int, beam: int, tasks: int) -> DataFrame:
    """Up to k nearest found of each query in its shard; rows of a (dim, shard, block) share a task.

    Sorted, a group's nodes come first: its graph is held once, and queries stream past it in batches.
    """
    keys = ["dim", "shard", "block"]
    asked = queries.select(*keys, F.lit(QUERY).alias("node"), "vector", F.array("vec_id").alias("ids"))
    rows = index.unionByName(asked, allowMissingColumns=True).repartition(tasks, *keys).sortWithinPartitions(*keys, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, nodes, graph = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in keys], axis=1)
            is_query = batch.column("node").to_numpy() == QUERY
            cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1) | (is_query[1:] != is_query[:-1])) + 1
            for start, stop in zip(np.r_[0, cuts], np.r_[cuts, len(marks)], strict=True):
                if start == stop:
                    continue
                if tuple(marks[start]) != group:
                    group, nodes, graph = tuple(marks[start]), [], None
                part = pa.Table.from_batches([batch.slice(start, stop - start)])
                if not is_query[start]:
                    nodes.append(part)
                    continue
                if nodes:
                    graph, nodes = Graph(pa.concat_tables(nodes)), []
                if graph is not None:
                    q, v, s = graph.search(part.column("ids").combine_chunks().flatten().to_numpy(), matrix(part, "vector"), k, beam)
                    yield pa.record_batch({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(v, pa.int64()), "score": pa.array(s, pa.float64())})

    return arrow_map(rows, run, RESULT)


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, beam: int = 128, shard_rows: tuple[int, int] = (10_000, 50_000), query_rows: int = 131_072) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for each row whose id is divisible by query_every, itself apart.

    shard_rows: least and most vectors of a shard; between them a table has 64 shards. beam: nodes that a search keeps
    in a shard of up to 10,000 vectors; in larger ones it grows with the square root of their size.
    query_rows: queries that stream past one copy of a shard; more of them bound a task's time, not its memory.
    """
    rows = usable(vectors).where(F.exists("vector", lambda x: x != 0)).withColumn("dim", F.size("vector"))
    rows = materialize(rows, "vectors")
    n, n_queries = rows.agg(F.count("*"), F.count(F.when(F.col("vec_id") % query_every == 0, 1))).first()
    shards, blocks = max(1, -(-n // min(max(n // 64, shard_rows[0]), shard_rows[1]))), max(1, -(-n_queries // query_rows))
    index = materialize(graphs(dealt(rows, "shard", shards), k), "graphs")
    queries = every(dealt(rows.where(F.col("vec_id") % query_every == 0), "block", blocks), "shard", shards)
    width = math.ceil(beam * max(1.0, n / shards / 10_000) ** 0.5)
    return best(searched(every(index, "block", blocks), queries, k, width, min(shards * blocks, MOST_TASKS)), k)
