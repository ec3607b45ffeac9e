"""BPE encoding and decoding of whole texts by batched numpy merge rounds.

For vocabularies whose words carry an end mark (`</w>`): a text is put in NFC and lower
case and cut into words, and a word's bytes are its first symbols. The symbols of many
words lie in one flat array. In each round every word merges its pair of lowest rank at
all its places; ranks are found by binary search over sorted pair keys. A text's ids are
those of its words in order; decoding joins the tokens with spaces, as the library does for
a file without a decoder.

What depends on the tables of Unicode (lower case, letters, digits, white space) is asked of the
library once for each distinct character outside ASCII; texts with a character that the library
treats in another way than this module go to the library whole. Words of more than
`LONG_WORD` symbols are merged one at a time by a heap, as rounds would number in the thousands.

Nulls and empty texts have no ids and decode to the empty text; a null id of a row stays null;
other columns are ignored; repeated rows give repeated rows; an empty table gives an empty table.
Texts of any length are encoded whole. Ids outside the vocabulary decode to nothing.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices

NEVER = np.int64(1) << 40
#: Words with more symbols are merged by a heap.
LONG_WORD = 512
#: Words kept with their ids in a Python worker, and the longest one kept (in characters).
CACHE_WORDS, CACHE_CHARS = 300_000, 48
# The kinds of words of this vocabulary family.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
# A file of another form isn't read by this module.
FORM = {"model": "BPE", "suffix": "</w>", "normalizers": ["NFC", "Replace", "Lowercase"], "pre_tokenizers": ["Split", "ByteLevel"]}


def byte_signs() -> list[str]:
    """The visible character that stands for each byte in the file: itself where it's visible in Latin-1, else the next one from U+0100 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in visible else chr(next(spare)) for b in range(256)]


class Vocabulary:
    """Tokens, and the pairs that merge with their ranks, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.text = f.read()
        spec = json.loads(self.text)
        model, vocab = spec["model"], spec["model"]["vocab"]
        form = {
            "model": model["type"],
            "suffix": model["end_of_word_suffix"],
            "normalizers": [x["type"] for x in spec["normalizer"]["normalizers"]],
            "pre_tokenizers": [x["type"] for x in spec["pre_tokenizer"]["pretokenizers"]],
        }
        if form != FORM or spec["decoder"] is not None or spec["post_processor"] is not None:
            raise ValueError(f"not a word BPE file of the known form: {path}")
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.specials.values()]) + 1
        self.tokens = [""] * self.size
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        signs, suffix = byte_signs(), model["end_of_word_suffix"]
        self.inner = np.array([vocab[s] for s in signs], np.int64)
        self.final = np.array([vocab[s + suffix] for s in signs], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        left, right = (np.array([vocab[p[side]] for p in pairs], np.int64) for side in (0, 1))
        into = np.array([vocab[a + b] for a, b in pairs], np.int64)
        order = np.argsort(left * self.size + right, kind="stable")
        self.keys, self.ranks, self.into = (left * self.size + right)[order], order.astype(np.int64), into[order]
        # All places of a pair merge in one round: a symbol is made before any pair that it is part of merges.
        made = np.full(self.size, -1)
        made[into] = np.arange(len(pairs))
        if np.any(np.maximum(made[left], made[right]) >= np.arange(len(pairs))) or len(np.unique(into)) < len(into):
            raise ValueError(f"merges of {path} use symbols before they are made")

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER if the pair doesn't merge) and merged symbol of each pair, by binary search."""
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], NEVER), self.into[at]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word, given as bytes (not empty); ids as 32-bit integers of this machine."""
        out = [b""] * len(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        for i in np.flatnonzero(lengths > LONG_WORD):
            out[i] = self.by_heap(words[i]).tobytes()
        short = np.flatnonzero(lengths <= LONG_WORD)
        for i, ids in zip(short.tolist(), self.by_rounds([words[i] for i in short]), strict=True):
            out[i] = ids
        return out

    def symbols(self, joined: bytes, ends: np.ndarray) -> np.ndarray:
        raw = np.frombuffer(joined, np.uint8)
        sym = self.inner[raw]
        sym[ends - 1] = self.final[raw[ends - 1]]
        return sym

    def by_rounds(self, words: list[bytes]) -> list[bytes]:
        """Rounds over one flat array: each word merges its lowest-rank pair at all its places; words without a pair leave."""
        if not words:
            return []
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        sym, seq = self.symbols(b"".join(words), np.cumsum(lengths)), np.repeat(np.arange(len(words)), lengths)
        rank, into = self.pair_ranks(sym, seq, np.arange(len(sym)))
        done_seq, done_sym = [], []
        while len(sym):
            first = np.flatnonzero(np.r_[True, seq[1:] != seq[:-1]])
            least = np.repeat(np.minimum.reduceat(rank, first), np.diff(np.r_[first, len(sym)]))
            over = least == NEVER
            if over.any():
                done_seq.append(seq[over])
                done_sym.append(sym[over])
                sym, seq, rank, into = (a[~over] for a in (sym, seq, rank, into))
                continue
            p = np.flatnonzero(rank == least)
            # Of overlapping places (aaa) every second merges, from the left.
            begins = np.r_[True, np.diff(p) != 1]
            p = p[(np.arange(len(p)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]
            sym[p] = into[p]
            keep = np.ones(len(sym), bool)
            keep[p + 1] = False
            now = (np.cumsum(keep) - 1)[p]
            sym, seq, rank, into = (a[keep] for a in (sym, seq, rank, into))
            fresh = np.r_[now, np.maximum(now - 1, 0)]
            rank[fresh], into[fresh] = self.pair_ranks(sym, seq, fresh)
        seq, sym = np.concatenate(done_seq), np.concatenate(done_sym)
        flat = sym[np.argsort(seq, kind="stable")].astype(np.uint32).tobytes()
        ends = (4 * np.cumsum(np.bincount(seq, minlength=len(words)))).tolist()
        return [flat[a:b] for a, b in zip([0, *ends], ends)]

    def pair_ranks(self, sym: np.ndarray, seq: np.ndarray, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the pairs that begin at places i."""
        j = np.minimum(i + 1, len(sym) - 1)
        rank, into = self.look_up(sym[i], sym[j])
        return np.where((j > i) & (seq[i] == seq[j]), rank, NEVER), into

    def by_heap(self, word: bytes) -> np.ndarray:
        """The same merges for one long word: a heap of (rank, place) over a linked list of symbols."""
        sym = self.symbols(word, np.array([len(word)])).tolist()
        after, before = [*range(1, len(sym)), -1], [-1, *range(len(sym) - 1)]
        rank, into = self.look_up(np.array(sym[:-1]), np.array(sym[1:]))
        heap = [(r, i, z, sym[i], sym[i + 1]) for i, (r, z) in enumerate(zip(rank.tolist(), into.tolist(), strict=True)) if r < NEVER]
        heapq.heapify(heap)
        known: dict[tuple[int, int], tuple[int, int]] = {}

        def push(i: int) -> None:
            j = after[i] if i >= 0 else -1
            if j < 0:
                return
            pair = (sym[i], sym[j])
            if pair not in known:
                r, z = self.look_up(np.array([pair[0]]), np.array([pair[1]]))
                known[pair] = int(r[0]), int(z[0])
            r, z = known[pair]
            if r < NEVER:
                heapq.heappush(heap, (r, i, z, *pair))

        while heap:
            _, i, z, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j < 0 or sym[j] != b:
                continue
            sym[i], sym[j] = z, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            push(i)
            push(before[i])
        return np.array([s for s in sym if s >= 0], np.uint32)

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, joined by spaces."""
        n, tokens = self.size, self.tokens
        return " ".join([tokens[i] for i in ids if 0 <= i < n and tokens[i]])


class Encoder:
    """Encodes whole texts in a Python worker; frequent words are remembered within a bound."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.seen, self.chars = vocabulary, {}, set(map(chr, range(128)))
        self.odd_chars: set[str] = set()
        # ASCII is checked like other characters.
        self.known(set(self.chars), fresh=True)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, vocabulary.specials)) + ")") if vocabulary.specials else None

    @property
    def library(self):
        if not hasattr(self, "_library"):
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_str(self.v.text)
            self._library.no_truncation()
            self._library.no_padding()
        return self._library

    def known(self, chars: set[str], fresh: bool = False) -> bool:
        """Whether this module and the library treat all these characters alike, each by itself and between letters."""
        for c in chars if fresh else chars - self.chars:
            self.chars.add(c)
            alike = unicodedata.category(c) != "Cn"
            for text in (c, f"a{c}b", f"1{c}1", f"-{c}-"):
                ids = np.frombuffer(b"".join(self.v.encode_words([w.encode() for w in self.words(text)])), np.uint32)
                alike = alike and ids.tolist() == self.library.encode(text, add_special_tokens=False).ids
            if not alike:
                self.odd_chars.add(c)
        return self.odd_chars.isdisjoint(chars)

    @staticmethod
    def words(text: str) -> list[str]:
        if text.isascii():
            return WORDS.findall(text.lower())
        # Characters are put in lower case one by one: the final sigma isn't a case of its own.
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())

    def odd(self, text: str) -> bool:
        return not text.isascii() and not (self.known(set(text)) and unicodedata.is_normalized("NFC", text)) or text.isascii() and not self.odd_chars.isdisjoint(text)

    def parts(self, text: str) -> list[str]:
        """Words, and special tokens that stand in the text; no word reads like one of these."""
        if self.specials is None or "<|" not in text:
            return self.words(text)
        out = []
        for piece in self.specials.split(text):
            out += [piece] if piece in self.v.specials else self.words(piece)
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        parts = [None if self.odd(t) else self.parts(t) for t in texts]
        needed = set().union(*(p for p in parts if p))
        if len(self.seen) + len(needed) > CACHE_WORDS or not self.seen:
            self.seen = {word: np.uint32(i).tobytes() for word, i in self.v.specials.items()}
        new = list(needed - self.seen.keys())
        self.seen.update(zip(new, self.v.encode_words([w.encode() for w in new]), strict=True))
        ids_of, out = self.seen.__getitem__, []
        for text, p in zip(texts, parts, strict=True):
            if p is None:
                out.append(np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32))
            else:
                out.append(np.frombuffer(b"".join(map(ids_of, p)), np.uint32))
        for w in [w for w in new if len(w) > CACHE_CHARS]:
            self.seen.pop(w, None)
        return out


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids array<int> of each row of docs. The vocabulary has a fixed size and is broadcast; one scan, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in slices(batches, "text"):
            ids = encoder.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return arrow_map(texts_of(docs), run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, path: str) -> DataFrame:
    """doc_id, text of rows with doc_id and ids; null ids are no ids."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [shared.value.decode([i for i in ids or [] if i is not None]) for ids in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return arrow_map(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")), run, "doc_id long, text string")


def round_trip_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, and the SHA-256 of the ids (little-endian, 32 bits) and of what they decode to, without moving either."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value)
        for b in slices(batches, "text"):
            ids = encoder.encode([t or "" for t in b.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    pa.array([len(x) for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(x.astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(shared.value.decode(x.tolist()).encode()).hexdigest() for x in ids], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return arrow_map(texts_of(docs), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def texts_of(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
