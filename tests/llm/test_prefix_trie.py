"""The trie against a plain one: many blocks and rounds, hot conversations, long ones, odd rows."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rivulet.llm import prefix_trie as pt

TABLE = "conv_id long, turn long, role string, text string"


def plain_trie(paths):
    """paths: conv_id -> list of turns, each (anything hashable, its length)."""
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * node[-1][1] if node else 0)
    out = []
    for node, own in members.items():
        ends = ",".join(map(str, sorted(c for c in own if len(paths[c]) == len(node))))
        out.append((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), len(children[node]), leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def plain_rebuilt(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", text or ""))
    digest = lambda role, text: hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
    turns = {c: [((r, t), len(t)) for _, _, r, t in sorted(x, key=lambda v: (*v[:3], digest(*v[2:])))] for c, x in own.items()}
    out = {}
    for c, mine in turns.items():
        h, first = zlib.crc32(str(c).encode()) % 6, c - (abs(c) % 100) * (1 if c >= 0 else -1)
        out[c] = turns.get(first, [])[:h] + mine[h:]
    return out


def got(frame):
    assert [t for _, t in frame.dtypes] == ["bigint"] * 7 + ["string"]
    return sorted((tuple(r) for r in frame.collect()), key=str)


def given(spark, paths):
    rows = [(c, [(hashlib.md5(repr(k).encode()).hexdigest(), n) for k, n in p]) for c, p in paths.items()]
    return spark.createDataFrame(rows, "conv_id long, turns array<struct<k:string,len:int>>").repartition(5)


@pytest.mark.parametrize("block", [8, 60, 100_000])
def test_random_tries(spark, block):
    """Few different turns, so that paths share much; blocks of a few turns make several rounds."""
    rng = random.Random(block)
    paths = {c: [rng.choice([("a", 2), ("b", 0), ("c", 5)]) for _ in range(rng.choice([0, 1, 2, 5, 9]))] for c in range(-40, 200)}
    assert got(pt.prefix_trie(given(spark, paths), block)) == plain_trie(paths)


def test_hot_paths_and_a_comb(spark):
    """Many copies of one long conversation, and conversations that leave it one turn after another."""
    long = [(i, i % 7) for i in range(150)]
    paths = {c: long for c in range(60)} | {100 + i: long[:i] + [(("own", i), i), ("end", 3)] for i in range(0, 150, 2)} | {400 + i: long[:i] for i in range(0, 150, 10)}
    want = plain_trie(paths)
    for block in (64, 1500):
        assert got(pt.prefix_trie(given(spark, paths), block)) == want


def test_rebuilt_table(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["hi", "hi there", "", None, "Ä" * 9])) for c in [*range(0, 130), 250, 251, 399, -5, -101] for t in range(rng.randint(1, 9))]
    rows += [(7, None, "system", "first"), (9, 3, "user", "hi"), (9, 3, "user", "hi"), (None, 1, "user", "x"), (11, 50, "user", "long " * 20_000)]
    rng.shuffle(rows)
    frame = spark.createDataFrame([(*r, 1, "z") for r in rows], TABLE + ", path int, `a.b` string").repartition(3)
    want = plain_trie(plain_rebuilt(rows))
    assert got(pt.conversation_trie(frame)) == want
    assert got(pt.conversation_trie(frame, block_turns=40)) == want
    turnless = plain_rebuilt(rows)
    assert any(not p for p in turnless.values())


def test_empty_and_single(spark):
    assert pt.conversation_trie(spark.createDataFrame([], TABLE)).count() == 0
    assert pt.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], TABLE)).count() == 0
    root = pt.prefix_trie(given(spark, {5: []})).collect()
    assert [tuple(r)[:7] for r in root] == [(5, 0, None, 1, 0, 1, 0)]


def test_ids_are_hashed_in_pieces(spark, monkeypatch):
    """The ids of a frequent path come in several strings; their hash is that of all of them in order."""
    monkeypatch.setattr(pt, "PIECE", 50)
    paths = spark.range(3000).select(F.col("id").alias("conv_id"), F.when(F.col("id") % 3 == 0, F.lit(b"a")).otherwise(F.lit(b"b")).alias("key"))
    found = {bytes(r.key): r.ends for r in pt.end_hashes(paths).collect()}
    for key, ids in ((b"a", range(0, 3000, 3)), (b"b", [i for i in range(3000) if i % 3])):
        assert found[key] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
