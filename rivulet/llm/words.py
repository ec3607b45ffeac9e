"""Words of texts as numbers, for the two classifiers."""

from __future__ import annotations

from itertools import islice

import numpy as np
from xxhash import xxh3_64_intdigest

#: Numbers of words that a Python worker keeps at most before it starts afresh.
MOST_WORDS = 50_000
EDGES = ".,;:!?\"'()[]{}<>*&%$#|~`_-+=/\\"


class Ids(dict):
    """Numbers words in the order in which they come."""

    def __missing__(self, word: str) -> int:
        self[word] = i = len(self)
        return i


class Vocabulary:
    """Turns words into rows of tables that `describe` makes for words not met before."""

    def __init__(self, describe, most: int = MOST_WORDS):
        self.describe, self.most, self.ids, self.tables = describe, most, Ids(), None

    def rows(self, words: list[str]) -> np.ndarray:
        if len(self.ids) > self.most:
            self.ids, self.tables = Ids(), None
        old = len(self.ids)
        rows = np.fromiter(map(self.ids.__getitem__, words), np.int64, len(words))
        if len(self.ids) > old or self.tables is None:
            new = self.describe(list(islice(self.ids, old, None)))
            self.tables = new if self.tables is None else tuple(np.concatenate(p) for p in zip(self.tables, new, strict=True))
        return rows


def bare(word: str) -> str:
    """Lower case without punctuation at either end."""
    return word.lower().strip(EDGES)


def bucket(key: str, n: int, seed: int = 0) -> int:
    return xxh3_64_intdigest(key.encode(), seed) % n


def shape(word: str) -> str:
    """Runs of capitals, small letters and digits as one sign each, other characters once in a row."""
    if word.isalpha() and word.islower():
        return "a"
    out = []
    for c in word:
        s = "A" if c.isupper() else "a" if c.isalpha() else "0" if c.isdigit() else c
        if not out or out[-1] != s:
            out.append(s)
    return "".join(out)
