"""Packing of tokenised documents into sequences of bounded length: bounded-space online best fit.

Every document becomes its token ids and an end id. Longer ones than a sequence
are cut into full pieces; the rest comes first, as the shorter piece. Full
pieces are sequences of their own. The others are dealt to windows of about a
fixed number of pieces; in each they arrive one by one, in the order of a hash, and go
into the open bin with the least free space that suffices. A window has at most
`open_bins` open bins, held by free space in a bitset. Where a new bin is needed and all
are open, the fullest closes first.

Null and empty texts are the end id alone. Repeated rows are packed as often as
they come; a null id stays null; other columns are ignored; an empty table gives
an empty table. Texts of any length are tokenised whole, long runs of white space too.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, materialize, slices

#: White space on which regular expression engines may differ.
ODD_SPACE = "[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
LONG_SPACE = 1_000


def byte_ranks(vocab: dict[str, int]) -> dict[bytes, int]:
    """Ranks of byte strings from a byte-level vocabulary, whose entries write each byte as one printable character."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    odd = [b for b in range(256) if b not in plain]
    of = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(odd)}
    return {bytes(of[c] for c in token): i for token, i in vocab.items() if all(c in of for c in token)}


class Encoder:
    """Ids of texts by a vocabulary file of the tokenizers library.

    The ids come from byte-pair ranks taken from the same file, several times
    faster than that library and with the same ids (the tests compare both).
    Where white space stands alone only, a pattern without look-ahead splits
    the same. Texts with special strings, with white space other than space, tab
    and line ends or with very long runs of it (where look-ahead runs out of stack)
    go to the library itself.
    """

    def __init__(self, tokenizer_json: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        ranks = byte_ranks({t: i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t not in special})
        made = lambda pattern: tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.full, self.single = made(PATTERN), made(PATTERN.replace(r"|\s+(?!\S)|\s+", r"|\s"))
        self.odd = re.compile("|".join([ODD_SPACE, r"\s{%d}" % LONG_SPACE, *map(re.escape, special)]))
        self.unusual = re.compile(r"\s\s|" + self.odd.pattern)

    def library(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def encode(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids of the text."""
        if not self.unusual.search(text):
            ids = self.single(text)
        else:
            ids = self.library(text) if self.odd.search(text) else self.full(text)
        return np.array(ids, "<u4").tobytes()


def cut(length: int, most: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first may be shorter than `most`."""
    first = length % most or most
    return [(0, first), *((s, most) for s in range(first, length, most))]


def pieces(docs: DataFrame, tokenizer_path: str, most: int = 2048, end_id: int = 0) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece. One scan, no shuffle; the vocabulary is broadcast."""
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = Encoder(shared.value)
        for b in slices(batches, "text"):
            rows = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = encoder.encode(text or "") + end
                rows += [(doc, k, s, n, zlib.crc32(ids[4 * s : 4 * (s + n)])) for k, (s, n) in enumerate(cut(len(ids) // 4, most))]
            doc_ids, k, s, n, c = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(k, pa.int32()), *(pa.array(x, pa.int64()) for x in (s, n, c))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), run, "doc_id long, piece int, start long, length long, ids_crc32 long")


class BestFit:
    """Online best fit with a bounded number of open bins."""

    def __init__(self, size: int, open_bins: int):
        self.size, self.open_bins = size, open_bins
        self.free_bits, self.bins, self.n_open, self.n_bins, self.forced = 0, {}, 0, 0, 0

    def add(self, length: int) -> tuple[int, int]:
        """Number of the bin and the place in it that an item of this length gets."""
        fits = self.free_bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            b = self._take(free)
        else:
            if self.n_open >= self.open_bins:
                self._take((self.free_bits & -self.free_bits).bit_length() - 1)
                self.forced += 1
            b, free = self.n_bins, self.size
            self.n_bins += 1
        if free > length:
            self.bins.setdefault(free - length, []).append(b)
            self.free_bits |= 1 << (free - length)
            self.n_open += 1
        return b, self.size - free

    def _take(self, free: int) -> int:
        own = self.bins[free]
        b = own.pop()
        if not own:
            del self.bins[free]
            self.free_bits &= ~(1 << free)
        self.n_open -= 1
        return b


def pack(docs: DataFrame, tokenizer_path: str, most: int = 2048, end_id: int = 0, open_bins: int = 128, pieces_per_window: int = 32_000) -> DataFrame:
    """Every piece with its sequence_id and offset.

    The pieces (a few numbers each) are written once; their count fixes the
    number of windows, so results don't depend on the cluster. A window's pieces
    arrive in the order of a hash: a rerun of a lost task gives the same sequences.
    Full pieces need no bin, so windows hold the others only.
    """
    table = materialize(pieces(docs, tokenizer_path, most, end_id), "pieces")
    windows = max(1, -(-table.where(F.col("length") < most).count() // pieces_per_window))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, fit = None, None
        for b in batches:
            at, offset = [], []
            for w, n in zip(b.column("window").to_pylist(), b.column("length").to_pylist(), strict=True):
                if w != window:
                    window, fit = w, BestFit(most, open_bins)
                s, o = fit.add(n)
                at.append((w << 24) + s)
                offset.append(o)
            yield pa.RecordBatch.from_arrays([*b.columns[2:], pa.array(at, pa.int64()), pa.array(offset, pa.int64())], [*b.schema.names[2:], "sequence_id", "offset"])

    arrival = F.xxhash64("doc_id", "piece", "start", "ids_crc32").alias("arrival")
    dealt = table.select(F.pmod(arrival, F.lit(windows)).alias("window"), arrival, "*").repartition(-(-windows // 2), "window")
    dealt = dealt.sortWithinPartitions("window", "arrival", "doc_id", "piece", "ids_crc32")
    return arrow_map(dealt, run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
