"""Exact top-k search by inner product: a KD-tree for each shard, traversed best first.

Vectors are turned into integers, floor(scale * x) for each component. A shard's
tree splits at the median of its widest dimension and keeps a tight bounding box
at each node. The largest inner product that a box allows bounds its subtree; a
query opens the most promising box first and stops when none can reach its k-th
score. Each query first searches the shard that it lies in itself; the k-th score
found there goes with it to the other shards, but only to those whose own bounding box
can reach it.

Shards are regions of space: the leaves of a tree of median splits, fitted on at most
`sample_rows` vectors (every vector is then placed). What a task holds is bounded by `shard_rows`
vectors and `query_rows` queries: a shard that holds more, as with many equal
vectors, is dealt out to parts by a hash of the id. At most about `most_shards` boxes (two
vectors each) are broadcast.

Vectors that are null or hold null or non-finite components take no part; vectors
of another length than the query's aren't candidates; repeated rows count once; a
query with fewer candidates than k gets them all. Extra columns are ignored; empty
tables give empty results. Scores beyond a long become the nearest long.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize
from .vectors import best, usable

LEAF = 256
LONG = (1 << 63) - 1


class Tree:
    """A KD-tree over the rows of a matrix; node i covers order[start:stop] within box lo..hi."""

    def __init__(self, points: np.ndarray):
        self.order = np.arange(len(points))
        self.start, self.stop, self.children, lo, hi = [], [], [], [], []

        def add(start: int, stop: int) -> int:
            own = points[self.order[start:stop]]
            node = len(self.start)
            self.start.append(start)
            self.stop.append(stop)
            lo.append(own.min(axis=0))
            hi.append(own.max(axis=0))
            self.children.append(None)
            return node

        todo = [add(0, len(points))] if len(points) else []
        while todo:
            node = todo.pop()
            start, stop, extent = self.start[node], self.stop[node], hi[node] - lo[node]
            if stop - start <= LEAF or not extent.size or not extent.max() > 0:
                continue
            axis, mid = int(extent.argmax()), (stop - start) // 2
            self.order[start:stop] = self.order[start:stop][np.argpartition(points[self.order[start:stop], axis], mid)]
            self.children[node] = (add(start, start + mid), add(start + mid, stop))
            todo += self.children[node]
        self.lo, self.hi = np.array(lo), np.array(hi)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """The largest inner product that each query can have in each node's box."""
        return np.maximum(queries, 0) @ self.hi.T + np.minimum(queries, 0) @ self.lo.T


def search(ids: np.ndarray, points: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, known: np.ndarray, k: int) -> list[tuple[int, int, int]]:
    """(query_id, vec_id, score) of up to k best points of each query, of those that reach its known k-th score."""
    exact = float(np.abs(points).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, points.shape[1]) < 2**52
    # Floats hold all sums exactly below 2**53; beyond, Python's integers do.
    if not exact:
        points, queries = (np.array([int(x) for x in a.ravel()], object).reshape(a.shape) for a in (points, queries))
        known = np.full(len(known), -np.inf)
    tree = Tree(points)
    if not len(ids):
        return []
    out, all_bounds = [], tree.bounds(queries)
    ids, points = ids[tree.order], points[tree.order]
    for query_id, q, bounds, least in zip(query_ids.tolist(), queries, all_bounds.tolist(), known.tolist(), strict=True):
        top_s, top_i = np.zeros(0, points.dtype), np.zeros(0, np.int64)
        heap = [(-bounds[0], 0)]
        while heap and -heap[0][0] >= least:
            node = heapq.heappop(heap)[1]
            if tree.children[node]:
                for child in tree.children[node]:
                    if bounds[child] >= least:
                        heapq.heappush(heap, (-bounds[child], child))
                continue
            own = slice(tree.start[node], tree.stop[node])
            scores, own_ids = points[own] @ q, ids[own]
            ok = (scores >= least) & (own_ids != query_id)
            if ok.any():
                top_s, top_i = np.r_[top_s, scores[ok]], np.r_[top_i, own_ids[ok]]
                if len(top_s) > k:
                    keep = np.lexsort((top_i, -top_s))[:k]
                    top_s, top_i = top_s[keep], top_i[keep]
                if len(top_s) == k:
                    least = max(least, top_s.min())
        out += [(query_id, i, max(-LONG - 1, min(LONG, int(s)))) for s, i in zip(top_s.tolist(), top_i.tolist(), strict=True)]
    return out


def matrix(table: pa.Table, column: str) -> np.ndarray:
    values = table.column(column).combine_chunks()
    flat = values.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(values), len(flat) // max(1, len(values)))


class Splits:
    """Median splits of the widest dimension, fitted on a sample; leaves are the shards, numbered from left to right."""

    def __init__(self, points: np.ndarray, depth: int):
        self.depth = depth
        self.dimension, self.value = np.zeros(2**depth, np.int64), np.full(2**depth, np.inf)
        todo = [(1, points)] if depth else []
        while todo:
            node, own = todo.pop()
            if len(own):
                self.dimension[node] = int((own.max(axis=0) - own.min(axis=0)).argmax())
                column = own[:, self.dimension[node]]
                self.value[node] = np.median(column)
                right = column > self.value[node]
                if 2 * node < 2**depth:
                    todo += [(2 * node, own[~right]), (2 * node + 1, own[right])]

    def shards(self, points: np.ndarray) -> np.ndarray:
        node = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            node = 2 * node + (points[np.arange(len(points)), self.dimension[node]] > self.value[node])
        return node - 2**self.depth


def split_trees(rows: DataFrame, counts: dict[int, int], shard_rows: int, most_shards: int, sample_rows: int) -> dict[int, Splits]:
    """Splits by length of vectors, for lengths of more than a shard; fitted on at most sample_rows vectors of each, picked by a hash of the id."""
    out, left = {}, most_shards
    for dim, n in sorted(counts.items(), key=lambda x: -x[1]):
        shards = min(-(-n // shard_rows), left)
        if shards < 2:
            continue
        depth = int(shards - 1).bit_length()
        left -= 2**depth
        own = rows.where(F.col("dim") == dim)
        picked = own.where(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n // sample_rows))) == 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows)
        out[dim] = Splits(matrix(picked.select("vector").toArrow(), "vector"), depth)
    return out


def by_batch(rows: DataFrame, added: str, f) -> DataFrame:
    """rows with the columns `added` (name kind, ...), made by f(dim, matrix, batch) -> (row numbers, arrays) for the vectors of one length."""
    names = [x.split()[0] for x in added.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = b.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                own = b.take(pa.array(np.flatnonzero(dims == dim)))
                at, arrays = f(dim, matrix(pa.table({"vector": own.column("vector")}), "vector"), own)
                own = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([*own.columns, *arrays], [*own.schema.names, *names])

    return arrow_map(rows, run, ", ".join([*(f"{c} {kind}" for c, kind in rows.dtypes), added]))


RESULT = "query_id long, vec_id long, score long"


def exact_top_k(
    vectors: DataFrame, query_every: int = 100, k: int = 10, scale: int = 1024, shard_rows: int = 16_384, query_rows: int = 16_384, most_shards: int = 8_192, sample_rows: int = 50_000, opened: list | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for each row whose id is divisible by query_every, itself apart.

    opened: gets the number of (query, shard) searches after those of the home shards, and of those without bounds.
    """
    # From 2**53 on a double is whole itself, and its floor may not fit a long.
    whole = F.transform("vector", lambda x: F.when(F.abs(x * scale) < 2.0**53, F.floor(x * scale).cast("double")).otherwise(x * scale))
    rows = materialize(usable(vectors).select("vec_id", whole.alias("vector"), F.size("vector").alias("dim")), "vectors")
    spark = rows.sparkSession
    counts = {r["dim"]: r["n"] for r in rows.groupBy("dim").agg(F.count("*").alias("n")).where(F.col("n") > shard_rows).collect()}
    trees = spark.sparkContext.broadcast(split_trees(rows, counts, shard_rows, most_shards, sample_rows))

    def place(dim: int, points: np.ndarray, b: pa.RecordBatch) -> tuple:
        own = trees.value.get(dim)
        shard = own.shards(points) if own else np.zeros(len(points), np.int64)
        return np.arange(len(points)), [pa.array(shard.astype(np.int32))]

    rows = materialize(by_batch(rows, "shard int", place), "sharded")
    # Shards of many equal vectors are dealt out by the id, so that none is larger than others; parts share their shard's box.
    sizes = rows.groupBy("dim", "shard").agg(F.count("*").alias("n"))
    sizes = materialize(sizes.select("dim", "shard", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts")), "sizes")
    large = sizes.where("parts > 1")
    cells = rows.join(F.broadcast(large) if large.count() <= most_shards else large, ["dim", "shard"], "left")
    cells = cells.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    queries = rows.where(F.col("vec_id") % query_every == 0)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        found = search(left.column("vec_id").to_numpy(), matrix(left, "vector"), right.column("vec_id").to_numpy(), matrix(right, "vector"), right.column("known").to_numpy(), k) if left.num_rows and right.num_rows else []
        q, i, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table({"query_id": pa.array(q, pa.int64()), "vec_id": pa.array(i, pa.int64()), "score": pa.array(s, pa.int64())})

    keys = ["dim", "shard", "part", "block"]

    def searched(q: DataFrame) -> DataFrame:
        """Queries with the shard to search: blocks of them meet all parts of the shard."""
        q = q.toDF(*q.columns)  # fresh columns: both sides come from one table
        blocks = q.groupBy("dim", "shard").agg(F.ceil(F.count("*") / query_rows).cast("int").alias("blocks"))
        q = q.join(blocks, ["dim", "shard"]).withColumn("block", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.col("blocks")).cast("int")).drop("blocks")
        q = q.join(sizes.toDF(*sizes.columns), ["dim", "shard"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        own = cells.join(blocks, ["dim", "shard"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
        return own.groupBy(keys).cogroup(q.groupBy(keys)).applyInArrow(run, RESULT)

    first = materialize(searched(queries.withColumn("known", F.lit(float("-inf")))), "nearest")
    if not counts:
        return best(first, k)
    # A shard's best rows can't be better than its box allows.
    tops = best(first, k).groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    known = F.coalesce(F.when(F.col("n") >= k, F.col("kth").cast("double")), F.lit(float("-inf")))
    rest = queries.where(F.col("dim").isin(list(counts))).withColumnRenamed("shard", "home")
    rest = rest.join(tops, F.col("vec_id") == F.col("query_id"), "left").withColumn("known", known).drop("query_id", "kth", "n")
    boxes = spark.sparkContext.broadcast(bounding_boxes(cells.where(F.col("dim").isin(list(counts)))))

    def open_shards(dim: int, points: np.ndarray, b: pa.RecordBatch) -> tuple:
        shards, lo, hi = boxes.value[dim]
        # Sums beyond 2**53 aren't exact: a bound may be too small by a part of this.
        slack = 1e-9 * (np.abs(points) @ np.maximum(np.abs(lo), np.abs(hi)).T)
        bound = np.maximum(points, 0) @ hi.T + np.minimum(points, 0) @ lo.T + slack
        # A bound that overflows to no number opens its shard.
        ok = ~(bound < b.column("known").to_numpy()[:, None]) & (shards[None, :] != b.column("home").to_numpy()[:, None])
        at, which = np.nonzero(ok)
        return at, [pa.array(shards[which].astype(np.int32))]

    rest = materialize(by_batch(rest, "shard int", open_shards).drop("home"), "opened")
    if opened is not None:
        opened += [rest.count(), queries.where(F.col("dim").isin(list(counts))).count() * (len(boxes.value[max(counts, key=counts.get)][0]) - 1)]
    return best(first.union(searched(rest)), k)


def bounding_boxes(cells: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By length of vectors: shards, and the least and largest values of each; a row for each batch and shard is summed up once more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        boxes: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            dims, shards = b.column("dim").to_numpy(), b.column("shard").to_numpy()
            vectors = b.column("vector").to_numpy(zero_copy_only=False)
            for key in set(zip(dims.tolist(), shards.tolist(), strict=True)):
                own = np.stack(vectors[(dims == key[0]) & (shards == key[1])])
                lo, hi = boxes.get(key, (own[0], own[0]))
                boxes[key] = (np.minimum(lo, own.min(axis=0)), np.maximum(hi, own.max(axis=0)))
        if boxes:
            d, s = zip(*boxes, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(s, pa.int32()), pa.array([x for x, _ in boxes.values()], pa.list_(pa.float64())), pa.array([x for _, x in boxes.values()], pa.list_(pa.float64()))], ["dim", "shard", "lo", "hi"])

    def merged(t: pa.Table) -> pa.Table:
        lo, hi = matrix(t, "lo").min(axis=0), matrix(t, "hi").max(axis=0)
        return pa.table({"dim": t.column("dim")[:1], "shard": t.column("shard")[:1], "lo": pa.array([lo], pa.list_(pa.float64())), "hi": pa.array([hi], pa.list_(pa.float64()))})

    kind = "dim int, shard int, lo array<double>, hi array<double>"
    found = arrow_map(cells.select("dim", "shard", "vector"), run, kind).groupBy("dim", "shard").applyInArrow(merged, kind).toArrow()
    out = {}
    for dim in set(found.column("dim").to_pylist()):
        own = found.filter(pc.equal(found.column("dim"), dim))
        out[dim] = (own.column("shard").to_numpy(), matrix(own, "lo"), matrix(own, "hi"))
    return out
