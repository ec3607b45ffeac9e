"""The corpus pipeline: every stage against a plain version of it, on odd rows, empty tables and whole."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from test_texts import brute_components, sets_of

import corpus_pipeline
from rivulet.llm import quality as q
from rivulet.llm.mixing import targets
from rivulet.llm.packing import cut
from rivulet.llm.queries import tokenizer
from rivulet.llm.secrets import all_spans, base_spans, learn

DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, score double"
LABELS = "doc_id long, quality int, toxic int"


def made() -> list[tuple]:
    rng = random.Random(4)
    words = ["river", "gauge", "level", "rises", "after", "rain", "near", "the", "old", "bridge", "today", "again", "water", "slowly"]
    good = lambda: " ".join(rng.choice(words) for _ in range(rng.randint(30, 80))).capitalize() + "."
    junk = lambda: " ".join(rng.choice(["!!!", "BUY", "$$$", "click", "FREE", "###", "win"]) for _ in range(40))
    texts = [good() for _ in range(60)] + [junk() for _ in range(20)]
    texts += [texts[3], texts[4] + " more", texts[5].replace("river", "stream", 1), texts[3]]
    texts += [good() + f" password = hunter{i}22x AKIA{'ABCDEFGHIJ0123456789'[i:]}{i}Z9" for i in range(6)]
    texts += [None, "", " \n\t", "word", "gauge " * 40_000, texts[0] + " " * 300_000 + texts[1], "x" * 200_000, "漢字 text"]
    rows = [(i, t, "en" if i % 5 else None, None if i % 11 == 0 else f"s{i % 3}", None if t is None or i % 7 == 0 else len(t), 7, 0.5) for i, t in enumerate(texts)]
    return [*rows, (None, "a row without an id rises after rain", None, None, None, None, None), rows[12], (13, texts[20], "en", "s1", 5, 1, 0.1)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """A folder with documents and labels, and one with empty tables."""
    full, empty = (str(tmp_path_factory.mktemp(x)) for x in ("full", "empty"))
    rows = made()
    labels = [(r[0], int("BUY" not in (r[1] or "BUY")), 0) for r in rows if r[0] is not None] + [(None, 1, 1), (3, None, None), (999, 0, 0)]
    for folder, keep in ((full, 1), (empty, 0)):
        spark.createDataFrame(rows[: len(rows) * keep], DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame(labels[: len(labels) * keep], LABELS).write.parquet(f"{folder}/labels.parquet")
    return full, empty


@pytest.fixture(scope="module")
def steps(spark, tables):
    """Input and output of each stage, the output written and read again."""
    docs, out = spark.read.parquet(f"{tables[0]}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = f"{tables[0]}/out-{name}"
        stage(spark, docs, tables[0]).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_keep_the_columns(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "secrets", "mix", "packing"]
    for name in ("quality", "near_dedup", "secrets", "mix"):
        before, after = steps[name]
        assert after.dtypes == before.dtypes


def test_quality_stage(spark, tables, steps):
    before, after = steps["quality"]
    machine = q.train(before, spark.read.parquet(f"{tables[0]}/labels.parquet"))
    good = lambda t: machine.margin(q.Featurizer().rows([t or ""], machine.scales, machine.edges))[0] >= 0
    assert rows_of(after) == Counter(tuple(r) for r in before.collect() if good(r.text))
    texts = {r.text for r in after.collect()}
    assert not any(t and "BUY" in t for t in texts) and len(texts) > 50


def test_near_dedup_stage(steps):
    before, after = steps["near_dedup"]
    rows = before.collect()
    by_id = defaultdict(list)
    for r in rows:
        if r.doc_id is not None:
            by_id[r.doc_id].append(r.text)
    ids = [i for i, own in by_id.items() for _ in own]
    component = brute_components(list(range(len(ids))), sets_of([t for own in by_id.values() for t in own], 5), 80)
    group = {}
    for k, i in enumerate(ids):  # versions of one id are one document
        group.setdefault(component[k], set()).add(i)
    of = {i: min(min(g) for g in group.values() if i in g) for i in by_id}
    kept = after.collect()
    words = lambda t: bool((t or "").split())
    assert Counter(r.doc_id for r in kept if words(r.text) and r.doc_id is not None) == Counter({i for i, own in by_id.items() if of[i] == i and any(map(words, own))})
    assert all(tuple(r) in {tuple(x) for x in rows} for r in kept)
    assert sum(r.doc_id is None for r in kept) == sum(r.doc_id is None for r in rows)


def test_secrets_stage(steps):
    before, after = steps["secrets"]
    formats = learn(before)

    def clean(t):
        if t is None:
            return None
        spans, keep = all_spans([t], formats)[0], [True] * len(t)
        for s, _, e in spans:
            keep[s:e] = [False] * (e - s)
        out = []
        for k, c in enumerate(t):
            if keep[k]:
                out.append(c)
            elif any(s == k for s, _, _ in spans) and (k == 0 or keep[k - 1] or not any(s < k < e for s, _, e in spans)):
                out.append("[secret]")
        return "".join(out)

    want = Counter((r.doc_id, clean(r.text) if r.text and len(r.text) < 5_000 else r.text) for r in before.collect())
    assert Counter((r.doc_id, r.text) for r in after.collect()) == want
    found = [r for r in before.collect() if base_spans(r.text or "")]
    assert found and not any(base_spans((r.text or "").replace("[secret]", " ")) for r in after.collect())


def test_mix_stage(steps):
    before, after = steps["mix"]
    n = lambda t: len((t or "").split())
    sizes, taken, of_id, out_of = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before.collect():
        sizes[r.source] += n(r.text)
        of_id[r.doc_id] += n(r.text)
    for r in after.collect():
        taken[r.source] += n(r.text)
        out_of[r.doc_id] += n(r.text)
        assert r.n_chars == len(r.text)
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    for s, t in zip(names, targets([sizes[s] for s in names]), strict=True):
        assert abs(taken[s] - t) <= 2 * 64
    assert all(out_of[i] <= 2 * of_id[i] for i in out_of)


def test_packing_stage(steps):
    from tokenizers import Tokenizer

    before, after = steps["packing"]
    library, want = Tokenizer.from_file(tokenizer("byte_bpe_50k.json")), Counter()
    for r in before.collect():
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((r.doc_id, k, s, m, zlib.crc32(ids[s : s + m].tobytes())) for k, (s, m) in enumerate(cut(len(ids), 2048)))
    rows = after.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        ends = [sum(m for _, m in sorted(own)[:k]) for k in range(len(own) + 1)]
        assert [o for o, _ in sorted(own)] == ends[:-1] and ends[-1] <= 2048


def test_run_and_empty_tables(spark, tables, steps):
    assert rows_of(corpus_pipeline.run(spark, tables[0]).drop("sequence_id", "offset")) == rows_of(steps["packing"][1].drop("sequence_id", "offset"))
    assert corpus_pipeline.run(spark, tables[1]).count() == 0


def test_stages_take_any_names_of_columns(spark):
    """Columns named like those that the operators use, with dots, and in other cases."""
    from rivulet.llm.mixing import mixed_documents
    from rivulet.llm.near_dedup import deduplicated

    odd = "`a.b` string, `__id` long, `__row` string, `ID` int, `row` int, `spans` string, `row_` int, `x``y` int"
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words), "s"), (2, " ".join(words), "s"), (3, "other words of its own here", "t"), (3, "second version of the same id", "t"), (4, None, None)]
    docs = spark.createDataFrame([(*r, "p", 7, "q", 8, 9, "z", 1, 2) for r in rows], "doc_id long, text string, source string, " + odd)
    kept = deduplicated(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    mixed = mixed_documents(docs.withColumnRenamed("ID", "Id2"), block_words=2)
    assert len(mixed.columns) == len(docs.columns) and {r["a.b"] for r in mixed.collect()} == {"p"} and {r["x`y"] for r in mixed.collect()} == {2}
