"""Encoding and decoding against the library: real texts, odd characters, long words, special tokens."""

import hashlib
import random
import struct

import pytest
from tokenizers import Tokenizer

from rivulet.llm import word_bpe
from rivulet.llm.queries import QUERIES, tokenizer

PATH = tokenizer("word_bpe_49k.json")
PARTS = ["a", "b", "'s", "'LL", "'T", " ", "  ", "\t", "\x1c", "\x85", "é", "é", "Σ", "ς", "ΑΣ", "İ", "ß", "ǅ", "漢字", "한", "하", "1", "²", "½", "٣", "!", "...", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "😀", "‍", "�", "", "͸", "K", "Å", "\U0001e900", "ﬁ", "ͅ", "\u0000", "﻿", "the", "hello", "WORLD", "aaaaaaa", "ha" * 400]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return word_bpe.Vocabulary(PATH)


def test_like_the_library(vocabulary, library):
    random.seed(5)
    texts = ["".join(random.choices(PARTS, k=random.randint(0, 25))) for _ in range(4000)]
    encoder = word_bpe.Encoder(vocabulary)
    for i in range(0, len(texts), 100):
        part = texts[i : i + 100]
        want = [e.ids for e in library.encode_batch(part, add_special_tokens=False)]
        assert [x.tolist() for x in encoder.encode(part)] == want
        assert [vocabulary.decode(x) for x in want] == [library.decode(x, skip_special_tokens=False) for x in want]


def test_most_odd_characters_stay_in_this_module(vocabulary):
    """Only what isn't in NFC and what Unicode's tables may not agree on goes to the library."""
    encoder = word_bpe.Encoder(vocabulary)
    assert not any(encoder.odd(t) for t in ("naïve Ärger", "漢字 한", "😀!", "<|endoftext|> ΑΣ", "don't"))
    assert encoder.odd("é") and encoder.odd("͸")


@pytest.mark.parametrize("word", ["the" * 3000, "qz" * 300 + "!" * 3000, "".join(random.Random(1).choices("abcdefgh", k=20_000)), "x" * 511, "x" * 513])
def test_long_words(vocabulary, library, word):
    want = library.encode(word, add_special_tokens=False).ids
    assert word_bpe.Encoder(vocabulary).encode([word, "b " + word])[0].tolist() == want


def test_rounds_and_heap_agree(vocabulary):
    words = ["".join(random.Random(i).choices("aabcdeth", k=1 + i % 200)).encode() for i in range(300)]
    assert vocabulary.by_rounds(words) == [vocabulary.by_heap(w).tobytes() for w in words]


def test_small_cache(vocabulary, library, monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_WORDS", 3)
    encoder = word_bpe.Encoder(vocabulary)
    for text in ("one two three four <|endoftext|> five", "one <|endoftext|>", "six seven eight nine one"):
        assert encoder.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


def test_frames(spark, library):
    rows = [(1, "Hello world's"), (1, "Hello world's"), (2, None), (3, ""), (None, "a"), (4, "é <|endoftext|> " + "long " * 20_000)]
    docs = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, ids int, `a.b` string").repartition(2)
    encoded = word_bpe.encode(docs, PATH)
    want = sorted(((i, library.encode(t or "", add_special_tokens=False).ids) for i, t in rows), key=str)
    assert sorted(((r.doc_id, r.ids) for r in encoded.collect()), key=str) == want
    decoded = sorted(((r.doc_id, r.text) for r in word_bpe.decode(encoded, PATH).collect()), key=str)
    assert decoded == sorted(((i, library.decode(ids, skip_special_tokens=False)) for i, ids in want), key=str)
    digests = sorted((tuple(r) for r in word_bpe.round_trip_digests(docs, PATH).collect()), key=str)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    assert digests == sorted(((i, len(ids), sha(struct.pack(f"<{len(ids)}I", *ids)), sha(library.decode(ids, skip_special_tokens=False).encode())) for i, ids in want), key=str)
    assert word_bpe.round_trip_digests(docs.limit(0), PATH).count() == 0
    odd = spark.createDataFrame([(1, None), (2, [0, None, 99_999, -1, 49_407])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in word_bpe.decode(odd, PATH).collect()} == {1: "", 2: "! <|endoftext|>"}


def test_query_on_all_documents(spark, sf_dir, library):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        want[r.doc_id] = (len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op12_word_bpe"](spark, sf_dir).collect()} == want
