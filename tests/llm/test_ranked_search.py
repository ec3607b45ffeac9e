"""Ranked search against a plain count of every document, on odd rows, many strata and small index blocks."""

import math
import random
import re

import numpy as np
import pytest

from rivulet.llm import ranked_search as rs

DOCS = "doc_id long, text string"
ITEMS = "item_id long, text string"


def plain(docs, items, k):
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    rows = [(i, terms(t)) for i, t in docs if i is not None]
    rows = [(i, ts) for i, ts in rows if ts]
    n_docs, length = len(rows), sum(len(ts) for _, ts in rows)
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, ts in asked.items():
        scored = []
        for i, own in rows:
            m = 100 - 50 + (50 * len(own) * n_docs) // length
            score = 0
            for t in ts:
                tf, df = own.count(t), sum(t in x for _, x in rows)
                if tf:
                    score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 20 * m))
            if score > 0:
                scored.append((-score, i))
        out += [(item, r + 1, i, -s) for r, (s, i) in enumerate(sorted(scored)[:k])]
    return sorted(out)


def found(spark, docs, items, k, parts=3):
    rows = rs.ranked_search(spark.createDataFrame(docs, DOCS).repartition(parts), spark.createDataFrame(items, ITEMS), k)
    assert rows.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]
    return sorted(tuple(r) for r in rows.collect())


def test_like_a_plain_count(spark, monkeypatch):
    """Documents of few and many lengths, with many equal scores; blocks of a few postings and one block."""
    random.seed(3)
    words = [f"w{i}" for i in range(30)] + ["Ärger", "über", "日本", "naïve"]
    docs = [(i, " ".join(random.choices(words, k=random.choice([1, 2, 3, 3, 3, 40, 300])))) for i in range(150)]
    docs += [(1000 + i, "w1 w2 same same") for i in range(60)]
    items = [(i, ", ".join(random.sample(words, 5))) for i in range(8)] + [(99, "same W1")]
    want = plain(docs, items, 20)
    assert found(spark, docs, items, 20) == want
    assert sum(r[0] == 99 for r in want) == 20
    for a in (50, 700):
        monkeypatch.setattr(rs, "POSTINGS", a)
        assert blocks(docs, items, 20) == want


def blocks(docs, items, k):
    """The operator's functions in this process, with the small blocks that a patched bound gives."""
    counts = [(i, rs.Counter(t for t in rs.terms_of(text) if t)) for i, text in docs]
    terms = sorted({t for _, text in items for t in rs.terms_of(text) if t})
    numbers = {t: j for j, t in enumerate(terms)}
    n_docs, length = len(counts), sum(sum(c.values()) for _, c in counts)
    weights = np.array([rs.term_weight(n_docs, sum(t in c for _, c in counts)) for t in terms], np.int64)
    of = {i: (np.array(sorted({numbers[t] for t in rs.terms_of(text) if t})), weights[sorted({numbers[t] for t in rs.terms_of(text) if t})]) for i, text in items}
    best, held = {i: rs.Best(k) for i in of}, []

    def flush():
        ids, n, own = [i for i, _, _ in held], np.array([n for _, n, _ in held]), [o for _, _, o in held]
        m, sizes = 50 + (50 * n * n_docs) // length, np.array([len(o) for o in own])
        rs.search(rs.Strata(np.array(ids), m, sizes, np.array([t for o in own for t, _ in o]), np.array([c for o in own for _, c in o]), len(terms)), of, best)
        held.clear()

    for i, c in counts:
        held.append((i, sum(c.values()), sorted((numbers[t], x) for t, x in c.items() if t in numbers)))
        if sum(len(o) for _, _, o in held) >= rs.POSTINGS:
            flush()
    if held:
        flush()
    return sorted((item, r + 1, int(i), int(s)) for item, b in best.items() for r, (i, s) in enumerate(zip(b.ids, b.scores, strict=True)))


def test_bounds_hold_and_prune():
    """No document scores above its stratum's bound, and a stratum that can't reach the k-th score isn't scored."""
    ids, m, sizes = np.arange(6), np.array([50, 50, 90, 90, 400, 400]), np.array([2, 1, 2, 1, 2, 1])
    index = rs.Strata(ids, m, sizes, np.array([0, 1, 0, 0, 1, 1, 0, 1, 1]), np.array([3, 1, 1, 1, 2, 5, 1, 1, 1]), 2)
    terms, weights = np.array([0, 1]), np.array([10, 20])
    bounds = index.bounds(terms, weights)
    for s in range(len(index.m)):
        assert index.score(s, terms, weights)[1].max() <= bounds[s]
    seen, best = [], {0: rs.Best(1)}
    score = index.score
    index.score = lambda s, *a: (seen.append(int(s)), score(s, *a))[1]
    rs.search(index, {0: (terms, weights)}, best)
    assert 2 not in seen and len(best[0].ids) == 1


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (3, "  ... "), (None, "abc"), (4, "abc ABC\x00abc-aBc"), (4, "abc"), (5, "abc " * 5000), (6, "É é"), (7, "É")]
    items = [(1, "abc abc"), (2, None), (None, "abc"), (3, "..."), (4, "é"), (4, "É"), (5, "unknown")]
    assert found(spark, docs, items, 3) == plain(docs, items, 3)
    assert found(spark, [], items, 3) == [] and found(spark, docs, [], 3) == []


def test_extra_columns_and_several_passes(spark, monkeypatch):
    monkeypatch.setattr(rs, "ITEMS", 2)
    docs, items = [(i, f"a{i % 3} b{i % 2} c") for i in range(20)], [(i, f"a{i} b1 c") for i in range(5)]
    frame = spark.createDataFrame([(*d, 1, 2, "x") for d in docs], DOCS + ", item_id int, score int, `a.b` string")
    rows = rs.ranked_search(frame, spark.createDataFrame([(*i, 5) for i in items], ITEMS + ", doc_id int"), 4)
    assert sorted(tuple(r) for r in rows.collect()) == plain(docs, items, 4)


@pytest.mark.parametrize("df, w", [(0, 1000 * math.log(22)), (10, 1000 * math.log(22 / 21))])
def test_weight(df, w):
    assert rs.term_weight(10, df) == math.floor(w)
