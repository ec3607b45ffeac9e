"""Token counts of whole texts for a BPE vocabulary with scores, by rank-synchronous array merging.

Texts are cut into pre-tokens (a run of spaces and the word after it). The
distinct pre-tokens of a batch lie in one flat numpy array; in each step every
sequence applies its lowest-rank pair, at all places where the merges of a
left-to-right library would give the same, until no pair is left. What counts
is the number of surviving symbols; a character outside the vocabulary counts
as its UTF-8 bytes (byte fallback).

Nulls and empty texts count 0 tokens and 0 bytes; a null id stays null; other
columns are ignored; repeated rows give repeated rows; an empty table gives an
empty table. Texts of any length are counted whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

SPACE = "▁"
NEVER = np.int64(1) << 40
#: Pre-tokens kept with their counts in a Python worker, and the longest one kept.
CACHE_ROWS, CACHE_CHARS = 400_000, 48
RUNS = re.compile(" +[^ ]*")


class Merges:
    """Pairs of symbols, what they merge to and in which order, as arrays.

    Symbols are numbers: first the pieces, then single characters that are only parts of pieces.
    """

    def __init__(self, pieces: list[str], scores: list[float]):
        known = {p: i for i, p in enumerate(pieces)}
        parts = sorted({c for p in pieces for c in p} - known.keys())
        symbols = known | {c: len(known) + i for i, c in enumerate(parts)}
        self.cost = np.array([1] * len(pieces) + [len(c.encode()) for c in parts], np.int64)
        chars = sorted((ord(c), i) for c, i in symbols.items() if len(c) == 1)
        self.chars = np.array([c for c, _ in chars], np.int64)
        self.char_symbols = np.array([i for _, i in chars], np.int64)
        order, places = np.unique(-np.array(scores), return_inverse=True)
        shared = np.bincount(places, minlength=len(order)) > 1
        found = {}
        for p, z in known.items():
            for cut in range(1, len(p)):
                x, y = symbols.get(p[:cut]), symbols.get(p[cut:])
                if x is not None and y is not None:
                    found[x << 32 | y] = z
        keys = np.array(list(found), np.int64)
        self.into = np.array(list(found.values()), np.int64)
        self.ranks = places[self.into].astype(np.int64) if len(keys) else np.zeros(0, np.int64)
        self.tied = shared
        # An open-addressing table of the pairs: slot -> number of the pair, -1 if free.
        self.bits = max(4, int(3 * len(keys)).bit_length())
        self.slots, self.slot_keys = np.full(1 << self.bits, -1, np.int32), np.full(1 << self.bits, -1, np.int64)
        left, at = np.arange(len(keys)), self.slot(keys)
        while len(left):
            free = self.slots[at] < 0
            won = np.zeros(len(left), bool)
            won[np.unique(at, return_index=True)[1]] = True
            won &= free
            self.slots[at[won]], self.slot_keys[at[won]] = left[won], keys[left[won]]
            left, at = left[~won], (at[~won] + ~free[~won]) & (len(self.slots) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if the pair doesn't merge) and merged symbol of each pair."""
        if not len(self.into):
            return np.full(len(left), NEVER), np.zeros(len(left), np.int64)
        keys = np.where((left >= 0) & (right >= 0), left << 32 | right, -2)
        at = self.slot(keys)
        there = self.slot_keys[at]
        away = np.flatnonzero((there != keys) & (there != -1))
        while len(away):
            at[away] = (at[away] + 1) & (len(self.slots) - 1)
            there[away] = self.slot_keys[at[away]]
            away = away[(there[away] != keys[away]) & (there[away] != -1)]
        pair = np.maximum(self.slots[at], 0)
        hit = there == keys
        return np.where(hit, self.ranks[pair], NEVER), self.into[pair]

    def count(self, words: list[str]) -> np.ndarray:
        """Surviving symbols of each word."""
        out = np.zeros(len(words), np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        seq = np.repeat(np.arange(len(words)), lengths)
        at = np.minimum(np.searchsorted(self.chars, points), len(self.chars) - 1)
        n_bytes = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
        sym = np.where(self.chars[at] == points, self.char_symbols[at], -n_bytes)

        def pair_ranks(i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            j = np.minimum(i + 1, len(sym) - 1)
            rank, into = self.look_up(sym[i], sym[j])
            return np.where((j > i) & (seq[i] == seq[j]), rank, NEVER), into

        rank, into = pair_ranks(np.arange(len(sym))) if len(sym) else (np.zeros(0, np.int64),) * 2
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            size = np.diff(np.r_[first, len(sym)])
            least = np.minimum.reduceat(rank, first)
            own_least = np.repeat(least, size)
            over = own_least == NEVER
            if over.any():
                np.add.at(out, seq[over], np.where(sym[over] >= 0, self.cost[np.maximum(sym[over], 0)], -sym[over]))
                sym, seq, rank, into = (a[~over] for a in (sym, seq, rank, into))
                continue
            p = np.flatnonzero(rank == own_least)
            # Of overlapping places (aaa) every second goes, from the left.
            run = np.cumsum(np.r_[True, np.diff(p) != 1]) - 1
            run_start = np.flatnonzero(np.r_[True, np.diff(p) != 1])
            p = p[(np.arange(len(p)) - run_start[run]) % 2 == 0]
            # A place is merged now if all merges left of it in its sequence make no pair of a lower rank.
            merged, q = into[p], seq[p]
            more = np.r_[False, q[1:] == q[:-1]]
            if more.any():
                many = more | np.r_[more[1:], False]
                ok = np.ones(len(p), bool)
                ok[many] = self.in_order(sym, seq, rank, p[many], merged[many])
                p, merged = p[ok], merged[ok]
            sym[p] = merged
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            now = (np.cumsum(keep) - 1)[p]
            sym, seq, rank, into = (a[keep] for a in (sym, seq, rank, into))
            fresh = np.r_[now, np.maximum(now - 1, 0)]
            rank[fresh], into[fresh] = pair_ranks(fresh)
        return out


    def in_order(self, sym, seq, rank, p, merged) -> np.ndarray:
        """Which of the places p, some in each sequence, can be merged at once: those up to the first that makes a pair of a lower rank."""
        q, end = seq[p], len(sym) - 1
        left, right = np.maximum(p - 1, 0), np.minimum(p + 2, end)
        chained = np.r_[False, np.diff(p) == 2] & np.r_[False, q[1:] == q[:-1]]
        before = np.where(chained, np.r_[merged[:1], merged[:-1]], sym[left])
        rank_l, rank_r = self.look_up(before, merged)[0], self.look_up(merged, sym[right])[0]
        rank_l[(p == 0) | (seq[left] != q)] = NEVER
        rank_r[(p + 2 > end) | (seq[right] != q)] = NEVER
        stop = (np.minimum(rank_l, rank_r) <= rank[p]) | self.tied[rank[p]]
        first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
        earlier = np.cumsum(stop) - stop
        return earlier == np.repeat(earlier[first], np.diff(np.r_[first, len(q)]))


def load_merges(path: str) -> Merges:
    """The normal pieces and scores of a sentencepiece BPE model file with dummy prefix and identity normaliser."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    return Merges([sp.id_to_piece(i) for i in ids], [sp.get_score(i) for i in ids])


class Counter:
    """Counts texts by their pre-tokens; frequent ones are remembered within a bound."""

    def __init__(self, merges: Merges):
        self.merges, self.seen = merges, {}

    @staticmethod
    def pre_tokens(text: str) -> list[str]:
        """Pre-tokens without the space that each begins with."""
        if not text:
            return []
        text = text.replace(SPACE, " ")
        return text.split(" ") if "  " not in text and text[0] != " " and text[-1] != " " else [x[1:] for x in RUNS.findall(" " + text)]

    def count(self, texts: list[str]) -> list[int]:
        split = [self.pre_tokens(t) for t in texts]
        new = list(set().union(*split) - self.seen.keys())
        counts = dict(zip(new, self.merges.count([SPACE + w.replace(" ", SPACE) for w in new]).tolist(), strict=True))
        if len(self.seen) + len(new) > CACHE_ROWS:
            counts |= {w: self.seen[w] for w in set().union(*split) & self.seen.keys()}
            self.seen = {}
        look_up = (self.seen | counts).__getitem__ if len(new) > len(self.seen) else None
        if look_up is None:
            self.seen.update(counts)
            look_up = self.seen.__getitem__
        totals = [sum(map(look_up, words)) for words in split]
        self.seen.update(counts)
        for w in [w for w in new if len(w) > CACHE_CHARS]:
            self.seen.pop(w, None)
        return totals


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) of each row of docs.

    The vocabulary has a fixed size and is broadcast. One scan, no shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_merges(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for b in slices(batches, "text"):
            texts = [t or "" for t in b.column("text").to_pylist()]
            n = counter.count(texts)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
