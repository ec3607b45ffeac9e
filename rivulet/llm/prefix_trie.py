"""The trie of conversations that share their first turns, by truncation peeling.

A conversation is a path of turn digests. Paths are sorted over the cluster and peeled in blocks of
bounded size: from the greatest depth of a block down, conversations that end at a depth join the nodes
that survive there, equal prefixes are grouped, and the last turn is stripped. A node is found and its
totals (members, children, leaves, saved tokens, smallest member) are complete in the same step.

Nodes on the first and the last path of a block may go on in its neighbours. They stay open: a block passes
on these two paths, each with what hangs at its nodes by then, and the paths of all blocks are peeled as
the conversations were, in fewer blocks each time, until one holds them all. Which subtree is large,
or which first turn is frequent, doesn't matter: blocks are cut by size wherever that falls.

Conversations that are alike throughout are one path with a count, made by Spark's partial aggregation; the
hash of a path's conversations streams over their ids in order, joined to strings before the last shuffle.
Texts are read once and only their digests (MD5 of role and text) and lengths move on. The
digests of one conversation lie in one row: 20 bytes a turn.

Turns of a conversation are ordered by number, null first; turns of equal number by role, then by the
digest of the text (rows that are alike in all count each). Null role or text is empty; rows without a
conv_id take no part; other columns are ignored. Turns of any length are read whole. An empty table has no
node; any other has the root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize

#: Turns that a block holds, unless it has fewer than LEAST_PATHS paths.
BLOCK_TURNS, LEAST_PATHS = 100_000, 8
#: Bytes of a turn's digest.
TURN = 16
#: Characters of joined ids in a row on its way to the hash.
PIECE = 1 << 16
NOTHING = hashlib.sha256(b"").hexdigest()

#: What hangs at each node of a path, from the root on: members known so far, the smallest of them, closed children, their leaves and saved tokens, and the hash of the conversations that end there.
PATH = "path binary, lens array<int>, convs array<long>, least array<long>, children array<long>, leaves array<long>, saved array<long>, ends array<string>"
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, node binary, block binary, parent binary"


def turn_digests(conversations: DataFrame) -> DataFrame:
    """conv_id, turns: the conversation's turns in order, each as digest (hex) and number of code points."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn"), role.alias("role"), F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)).alias("k"), F.length(text).alias("len")).alias("t"),
    )
    turns = F.transform(F.sort_array(F.collect_list("t")), lambda t: F.struct(t["k"].alias("k"), t["len"].alias("len")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(turns: DataFrame, family: int = 100, shared: int = 6) -> DataFrame:
    """conv_id, turns: the first h turns of the family's first conversation, then the own turns after the first h; h = crc32(conv_id) % shared."""
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    first = F.col("conv_id") - F.col("conv_id") % family
    # A family's head is a few digests, and has at most 2 * family members.
    heads = turns.where(first == F.col("conv_id")).select(F.col("conv_id").alias("_first"), F.slice("turns", 1, shared - 1).alias("_head"))
    rows = turns.select("conv_id", "turns", h.alias("_h"), first.alias("_first")).join(heads, "_first", "left")
    none = F.slice("turns", 1, 0)
    head = F.when(F.col("_h") > 0, F.slice(F.coalesce("_head", none), F.lit(1), F.col("_h"))).otherwise(none)
    return rows.select("conv_id", F.concat(head, F.slice("turns", F.col("_h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns"))


def as_paths(conversations: DataFrame) -> DataFrame:
    """conv_id, path, lens, key (digest of the path) of conversations with their turns."""
    path = F.array_join(F.transform("turns", lambda t: t["k"]), "")
    return conversations.select("conv_id", F.unhex(path).alias("path"), F.transform("turns", lambda t: t["len"]).alias("lens"), F.unhex(F.md5(path)).alias("key"))


def end_hashes(paths: DataFrame) -> DataFrame:
    """key, ends: for each path the SHA-256 of its conversations' ids in decimal, ascending and comma-joined."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, first, parts, size, done = None, 0, [], 0, []

        def rows() -> pa.RecordBatch:
            keys, firsts, joined = zip(*done, strict=True) if done else ((), (), ())
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(joined, pa.string())], ["key", "first", "part"])

        for b in batches:
            for k, c in zip(b.column("key").to_pylist(), b.column("conv_id").to_pylist(), strict=True):
                if k != key or size > PIECE:
                    if parts:
                        done.append((key, first, ",".join(parts)))
                    key, first, parts, size = k, c, [], 0
                parts.append(str(c))
                size += len(parts[-1]) + 1
            yield rows()
        if parts:
            done.append((key, first, ",".join(parts)))
            yield rows()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            keys, ends = [], []
            for k, part in zip(b.column("key").to_pylist(), b.column("part").to_pylist(), strict=True):
                if k != key:
                    if state is not None:
                        keys.append(key)
                        ends.append(state.hexdigest())
                    key, state = k, hashlib.sha256(part.encode())
                else:
                    state.update(b"," + part.encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends, pa.string())], ["key", "ends"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["key", "ends"])

    ids = paths.select("key", "conv_id").repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    joined = arrow_map(ids, pieces, "key binary, first long, part string")
    return arrow_map(joined.repartition("key").sortWithinPartitions("key", "first"), hashes, "key binary, ends string")


def distinct_paths(paths: DataFrame) -> DataFrame:
    """The distinct paths, each with the number and the smallest of its conversations and their hash, as rows of PATH."""
    alike = paths.groupBy("key").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"), F.first("path").alias("path"), F.first("lens").alias("lens"))
    rows = alike.join(end_hashes(paths), "key")
    at_end = lambda x, none, kind: F.concat(F.array_repeat(F.lit(none).cast(kind), F.size("lens")), F.array(x.cast(kind))).alias
    zeros = F.array_repeat(F.lit(0).cast("long"), F.size("lens") + 1)
    return rows.select(
        "path", "lens", at_end(F.col("n"), 0, "long")("convs"), at_end(F.col("least"), (1 << 63) - 1, "long")("least"),
        zeros.alias("children"), zeros.alias("leaves"), zeros.alias("saved"), at_end(F.col("ends"), None, "string")("ends"),
    )


def common_turns(a: bytes, b: bytes) -> int:
    """Number of turns at the start that two paths share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // TURN
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // TURN


class Node:
    """Columns of totals of the nodes of one depth."""

    def __init__(self, convs, least, children, leaves, saved, ends):
        self.convs, self.least, self.children, self.leaves, self.saved, self.ends = convs, least, children, leaves, saved, ends


def peel(rows: list[dict], close: bool, keyed: bool) -> tuple[list[tuple], list[dict]]:
    """Peels sorted, distinct paths: rows of NODE, and the open paths with what hangs at their nodes. close: nothing is open; keyed: nodes get their digest.

    The nodes of depth d begin at the rows that share fewer than d turns with the row before.
    """
    paths = [r["path"] for r in rows]
    n = np.array([len(p) // TURN for p in paths])
    lcp = np.array([-1, *(common_turns(a, b) for a, b in zip(paths, paths[1:], strict=False))])
    deepest = int(n.max())
    # What each row holds at its depths, by depth: all rows that reach it.
    reach = np.argsort(-n, kind="stable")
    counts = np.searchsorted(-n[reach], -np.arange(deepest + 1), "right")
    sums = {c: [np.asarray(r[c], np.int64) for r in rows] for c in ("convs", "least", "children", "leaves", "saved")}
    lens, plain = [np.asarray(r["lens"], np.int64) for r in rows], all(len(r["convs"]) == 1 or not any(r["convs"][:-1]) and not any(r["children"]) for r in rows)
    ending = {int(d): np.flatnonzero(n == d) for d in np.unique(n)}
    block = hashlib.md5(paths[0] + n.size.to_bytes(8, "little") + paths[-1]).digest()
    opened = [] if close else [0] if len(rows) == 1 else [0, len(rows) - 1]
    seams = {r: {c: np.zeros(n[r] + 1, np.int64) for c in ("convs", "children", "leaves", "saved")} | {"least": np.full(n[r] + 1, (1 << 63) - 1), "ends": [None] * (n[r] + 1)} for r in opened}
    prefix = {r: prefix_digests(paths[r]) for r in (range(len(rows)) if keyed else opened)}
    out: list[tuple] = []
    below = None  # of the depth before: start rows of its closed nodes, their totals, their output rows
    for d in range(deepest, -1, -1):
        starts = np.flatnonzero((lcp < d) & (n >= d))
        size = len(starts)
        convs, children, leaves, saved = (np.zeros(size, np.int64) for _ in range(4))
        least, ends = np.full(size, (1 << 63) - 1), [None] * size
        # Conversations that end here, or what hung here before, join the survivors.
        here = ending.get(d, ()) if plain else np.sort(reach[: counts[d]])
        if len(here):
            node = np.searchsorted(starts, here, "right") - 1
            for total, c in ((convs, "convs"), (children, "children"), (leaves, "leaves"), (saved, "saved")):
                np.add.at(total, node, np.fromiter((sums[c][r][d] for r in here), np.int64, len(here)))
            np.minimum.at(least, node, np.fromiter((sums["least"][r][d] for r in here), np.int64, len(here)))
            for r, k in zip(here.tolist(), node.tolist(), strict=True):
                if rows[r]["ends"][d] is not None:
                    ends[k] = rows[r]["ends"][d]
        if below is not None:
            old, totals, made = below
            node = np.searchsorted(starts, old, "right") - 1
            np.add.at(convs, node, totals.convs)
            np.add.at(children, node, 1)
            np.add.at(leaves, node, totals.leaves)
            np.add.at(saved, node, totals.saved)
            np.minimum.at(least, node, totals.least)
        open_at = {}
        if not close:
            if n[0] >= d:
                open_at[0] = 0
            if n[-1] >= d:
                open_at.setdefault(size - 1, len(rows) - 1)
        if below is not None:
            for k, row in zip(node.tolist(), made, strict=True):
                if k in open_at:
                    out.append((*row[:2], None, *row[3:9], block, prefix[open_at[k]][d]))
                else:
                    out.append((*row[:2], int(least[k]), *row[3:9], None, None))
        for k, r in open_at.items():
            s = seams[r]
            s["convs"][d], s["children"][d], s["leaves"][d], s["saved"][d], s["least"][d], s["ends"][d] = convs[k], children[k], leaves[k], saved[k], least[k], ends[k]
        closed = np.array([k for k in range(size) if k not in open_at], np.int64) if open_at else np.arange(size)
        last = np.fromiter((lens[r][d - 1] for r in starts[closed]), np.int64, len(closed)) if d else np.zeros(len(closed), np.int64)
        totals = Node(convs[closed], least[closed], children[closed], np.where(children[closed] == 0, 1, leaves[closed]), saved[closed] + (convs[closed] - 1) * last, None)
        made = [
            (int(totals.least[i]), d, None, int(totals.convs[i]), int(totals.children[i]), int(totals.leaves[i]), int(totals.saved[i]), ends[k] or NOTHING, prefix[starts[k]][d] if keyed else None)
            for i, k in enumerate(closed.tolist())
        ]
        below = (starts[closed], totals, made)
    out += [(*row[:2], None, *row[3:9], None, None) for row in below[2]]
    return out, [{"path": paths[r], "lens": lens[r].tolist(), **{c: v if c == "ends" else v.tolist() for c, v in s.items()}} for r, s in seams.items()]


def prefix_digests(path: bytes) -> list[bytes]:
    """A digest of each prefix of a path, from the empty one on."""
    state, out = hashlib.md5(), [hashlib.md5().digest()]
    for i in range(0, len(path), TURN):
        state.update(path[i : i + TURN])
        out.append(state.digest())
    return out


def peeled(paths: DataFrame, close: bool, keyed: bool, block_turns: int = BLOCK_TURNS, least_paths: int = LEAST_PATHS) -> DataFrame:
    """A row with `node` for each node that is complete, and a row with `open` for each path that isn't. close: all in one block."""
    kind = f"node struct<{','.join(c.replace(' ', ':') for c in NODE.split(', '))}>, open struct<{','.join(c.replace(' ', ':', 1) for c in PATH.split(', '))}>"
    names = [c.split()[0] for c in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, held, turns = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            nodes, seams = peel(held, close, keyed)
            for i in range(0, len(nodes), 10_000):
                yield rows([dict(zip(names, x, strict=True)) for x in nodes[i : i + 10_000]], [])
            yield rows([], seams)

        def rows(nodes: list[dict], seams: list[dict]) -> pa.RecordBatch:
            k, types = len(nodes) + len(seams), (node_type(), path_type())
            arrays = [pa.array([*nodes, *[None] * len(seams)], types[0]), pa.array([*[None] * len(nodes), *seams], types[1])]
            assert all(len(a) == k for a in arrays)
            return pa.RecordBatch.from_arrays(arrays, ["node", "open"])

        for b in batches:
            for row in b.to_pylist():
                size = len(row["path"]) // TURN + 1
                if not close and len(held) >= least_paths and turns + size > block_turns:
                    yield from done()
                    held, turns = [], 0
                held.append(row)
                turns += size
        if held:
            yield from done()

    ordered = paths.coalesce(1) if close else paths.repartitionByRange("path")
    return arrow_map(ordered.sortWithinPartitions("path"), run, kind)


def node_type() -> pa.DataType:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in NODE.split(", ")])


def path_type() -> pa.DataType:
    kinds = {"binary": pa.binary(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64()), "array<string>": pa.list_(pa.string())}
    return pa.struct([(c.split()[0], kinds[c.split()[1]]) for c in PATH.split(", ")])


def prefix_trie(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row a node of the trie of conversations, given as conv_id and turns (array of k, len, in order).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.
    """
    paths = materialize(as_paths(conversations), "paths")
    todo, rounds = materialize(distinct_paths(paths), "distinct-paths"), []
    discard(paths)
    while True:
        size = todo.agg(F.count("*").alias("paths"), F.coalesce(F.sum(F.size("lens") + 1), F.lit(0)).alias("turns")).first()
        last = size.paths <= LEAST_PATHS or size.turns <= block_turns
        found = materialize(peeled(todo, last, bool(rounds), block_turns), "peeled")
        discard(todo)
        rounds.append(found)
        if last:
            break
        todo = materialize(found.where("open is not null").select("open.*"), "open-paths")
    nodes = reduce(DataFrame.unionByName, [r.where("node is not null").select("node.*") for r in rounds])
    shown = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if len(rounds) == 1:
        return nodes.select(shown)
    # The parents of nodes that hung at an open path: one row for each block and parent, so no key is frequent.
    waiting = nodes.where("parent is not null")
    known = nodes.where("node is not null").select(F.col("node").alias("parent"), F.col("conv_id").alias("found"))
    asked = waiting.select("block", "parent").distinct().join(known, "parent")
    answered = waiting.drop("parent_conv_id").join(asked, ["block", "parent"]).withColumnRenamed("found", "parent_conv_id")
    return nodes.where("parent is null").select(shown).unionByName(answered.select(shown))


def conversation_trie(conversations: DataFrame, family: int = 100, shared: int = 6, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """The trie of the rebuilt conversations of a table with conv_id, turn, role and text."""
    turns = materialize(turn_digests(conversations), "turns")
    return prefix_trie(rebuilt(turns, family, shared), block_turns)
