"""The classifiers: held-out accuracy, and defined results of odd rows."""

import zlib

import numpy as np
import pytest

from rivulet.llm.quality import Featurizer, fit, quality_scores, without_rejected
from rivulet.llm.queries import op8_quality, op9_toxicity
from rivulet.llm.toxicity import Network, Scorer, best_threshold, calibrated_line, toxicity_scores, train_on

DATA = "/root/testdata/sf0.01"


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


@pytest.fixture(scope="module")
def labelled(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text", "lang")
    rows = docs.join(spark.read.parquet(f"{DATA}/labels.parquet"), "doc_id").orderBy("doc_id").collect()
    return [r for r in rows if not held_out(r.doc_id)], [r for r in rows if held_out(r.doc_id)]


def test_quality_of_unseen_texts(labelled):
    train, test = labelled
    m = fit([r.text for r in train], np.array([r.quality for r in train], np.float32))
    p = 1 / (1 + np.exp(-m.margin(Featurizer().rows([r.text for r in test], m.scales, m.edges))))
    assert np.mean((p >= 0.7) == np.array([r.quality for r in test])) >= 0.95


def test_pairs_by_the_squares(labelled):
    """The linear-time sum over pairs equals the sum over all pairs."""
    m = fit([r.text for r in labelled[0][:40]], np.array([r.quality for r in labelled[0][:40]], np.float32), epochs=1)
    s = Featurizer().rows(["some words here, some MORE words!!"], m.scales, m.edges)
    v = m.factors[s.feature].astype(float) * s.value[:, None]
    pairs = sum(float(v[i] @ v[j]) for i in range(len(v)) for j in range(i))
    assert m.margin(s)[0] == pytest.approx(m.bias + float(m.weights[s.feature] @ s.value) + pairs, abs=1e-4)


def test_toxicity_of_unseen_texts():
    rng = np.random.default_rng(1)
    words = ["ra", "men", "tol", "ki", "sa", "ver", "nu"]
    made = lambda bad: " ".join(["".join(rng.choice(words, 3)) for _ in range(60)] + (["xylo" + "".join(rng.choice(words, 1))] if bad else []))
    y = (np.arange(700) % 5 == 0).astype(np.float32)
    texts = [made(b) for b in y]
    net = train_on(texts[:500], y[:500], ["en"] * 500)
    p = Scorer(net).scores(texts[500:])
    assert np.mean((p >= 0.3) == (y[500:] > 0)) >= 0.97
    assert "en" in net.thresholds


def test_toxicity_equals_plain_loops():
    """Scores against a convolution written out word by word."""
    from rivulet.llm.toxicity import DIMENSIONS, FILTERS, PLACES, WIDTHS, parts

    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["sun", "rain", "wind", "snowing", "hail", "Fog!"], rng.integers(0, 9))) for _ in range(30)]
    net = train_on(texts, (np.arange(30) % 3 == 0).astype(np.float32), [None] * 30)
    for text, got in zip(texts, Scorer(net).scores(texts), strict=True):
        vectors = [net.embeddings[parts([w])[0][0]].sum(axis=0).astype(float) for w in text.split()]
        z = float(net.bias)
        for i, w in enumerate(WIDTHS):
            for f in range(FILTERS):
                values = [sum(vectors[at + k][d] * net.kernels[PLACES.index((w, k)), d, f] for k in range(w) for d in range(DIMENSIONS)) + net.shifts[i, f] for at in range(len(vectors) - w + 1)]
                z += net.weights[i * FILTERS + f] * max([0.0, *values])
        assert got == pytest.approx(1 / (1 + np.exp(-(net.line[0] * z + net.line[1]))), abs=1e-4)


def test_the_registered_queries_on_unseen_labels(spark):
    """Held-out accuracy of the whole queries on the largest test tables, with the contract's thresholds."""
    folder = "/root/testdata/sf0.1"
    labels = {r.doc_id: r for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}

    def hits(query, label):
        rows = [(r.predicted == 1, labels[r.doc_id][label] == 1) for r in query(spark, folder).where("held_out").collect() if r.doc_id in labels]
        p, y = np.array(rows).T
        return (p == y).mean(), 2 * (p & y).sum() / (p.sum() + y.sum())

    assert hits(op8_quality, "quality")[0] >= 0.97
    accuracy, f1 = hits(op9_toxicity, "toxic")
    assert accuracy >= 0.97 and f1 >= 0.9


def test_sample_is_bounded(spark):
    """An id that many rows hold counts once, and texts are taken up to a number of bytes."""
    from rivulet.llm.common import labelled_sample

    docs = spark.createDataFrame([(i % 40, f"text {i % 40} " * 50) for i in range(4000)] + [(1, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    rows = labelled_sample(docs, labels, "quality", 10).collect()
    assert len(rows) == len({r.doc_id for r in rows}) == 10 and all(r.lang is None for r in rows)
    few = labelled_sample(docs, labels, "quality", 10, max_bytes=1500).collect()
    assert 0 < len(few) < 10 and sum(len(r.text) for r in few) <= 1500


def test_shapes_of_whole_words():
    from rivulet.llm.words import shape

    assert shape("a" * 40 + "7B") == "a0A" and shape("x" * 24) != shape("x" * 24 + "9")


def test_calibration():
    z = np.array([-3.0, -2, -1, 1, 2, 3])
    a, b = calibrated_line(z, np.array([0, 0, 0, 1, 1, 1.0]))
    assert a > 0 and abs(b) < 0.5
    assert best_threshold(np.array([0.1, 0.2, 0.8]), np.array([0, 0, 1.0])) == pytest.approx(0.5)


def test_odd_rows(spark):
    schema = "doc_id long, text string, lang string, n_chars long, score double, held_out string"
    rows = [(i, t, None, None, 1.0, "x") for i, t in enumerate([None, "", " \n", "a", "w " * 20_000, "漢字 text !!", "漢字 text !!"])] + [(None, "null id", "en", 1, 1.0, "x"), (3, "a", "en", 1, 1.0, "x")]
    docs, empty = spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)
    labels = spark.createDataFrame([(3, 1, 0), (4, 0, 1), (5, 1, None), (None, 1, 1), (6, None, 0), (99, 0, 0)], "doc_id long, quality int, toxic int")
    none = labels.limit(0)
    for scores in (quality_scores, toxicity_scores):
        for own in (labels, none):
            got = scores(docs, own).collect()
            assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
            assert all(r.held_out == (r.doc_id is not None and held_out(r.doc_id)) for r in got)
        assert scores(empty, labels).count() == 0
    kept = without_rejected(docs, fit(["good text"], np.array([1.0], np.float32)), 0.5)
    assert kept.schema == docs.schema and kept.count() == len(rows)


def test_windows_stay_in_their_text():
    """Pooled values of texts scored together equal those of texts scored alone."""
    rng = np.random.default_rng(2)
    net = train_on([" ".join(rng.choice(["aa", "bb", "cc", "dd"], 5)) for _ in range(40)], (np.arange(40) % 2).astype(np.float32), [None] * 40)
    assert isinstance(net, Network)
    texts = ["aa bb cc", "", "dd", "bb aa", "cc cc cc cc", ""]
    together = Scorer(net).scores(texts)
    assert np.allclose(together, [Scorer(net).scores([t])[0] for t in texts])


def test_sample_passes_over_texts_that_do_not_fit(spark):
    """One huge text first in the order of the hashes costs no other label."""
    from pyspark.sql import functions as F

    from rivulet.llm.common import is_training_row, labelled_sample

    ids = [r.doc_id for r in spark.range(400).select(F.col("id").alias("doc_id")).where(is_training_row()).orderBy(F.xxhash64("doc_id")).limit(50).collect()]
    docs = spark.createDataFrame([(i, "x" * (5000 if k in (0, 7) else 10)) for k, i in enumerate(ids)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in ids], "doc_id long, quality int")
    got = sorted(r.doc_id for r in labelled_sample(docs, labels, "quality", 1000, max_bytes=600).collect())
    assert got == sorted(i for k, i in enumerate(ids) if k not in (0, 7))
    # Those that come first by hash are taken while they fit.
    assert sorted(r.doc_id for r in labelled_sample(docs, labels, "quality", 1000, max_bytes=5010).collect()) == sorted([ids[0], ids[1]])


def test_labels_of_absent_documents_take_no_place(spark):
    from rivulet.llm.common import labelled_sample

    docs = spark.createDataFrame([(i, f"text {i}") for i in range(40)], "doc_id long, text string")
    labels = spark.range(20_000).selectExpr("id as doc_id", "1 as quality")
    assert labelled_sample(docs, labels, "quality", 10).count() == 10
    assert labelled_sample(docs, labels, "quality", 1000).count() == labelled_sample(docs, docs.selectExpr("doc_id", "1 as quality"), "quality", 1000).count() > 20


def test_toxicity_learns_from_all_labelled_rows(spark):
    """Label 1 is only in rows that come last by hash: a bounded sample would learn from one label alone."""
    from pyspark.sql import functions as F

    from rivulet.llm.common import is_training_row

    ids = [r.doc_id for r in spark.range(13_000).select(F.col("id").alias("doc_id")).where(is_training_row()).orderBy(F.xxhash64("doc_id")).collect()]
    assert len(ids) > 8_500
    rows = [(i, f"calm{i % 97} day{i % 89}" + (" venomous" if k >= 8_000 else " sunny"), int(k >= 8_000)) for k, i in enumerate(ids)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    got = {r.doc_id: r.score for r in toxicity_scores(docs, labels).collect()}
    assert np.mean([(got[i] >= 0.3) == (y == 1) for i, _, y in rows]) >= 0.99


def test_shards_are_averaged_and_counts_are_exact(spark):
    """Counts by fold and label add up over all blocks; networks of several shards together tell the labels apart."""
    from rivulet.llm.toxicity import BUCKETS, block_of, count, train

    rng = np.random.default_rng(5)
    rows = [(i, " ".join(rng.choice(["sun", "rain", "wind", "hail"], 8)) + (" xylo" if i % 5 == 0 else ""), int(i % 5 == 0), "en") for i in range(1200)]
    texts, y = [r[1] for r in rows], np.array([r[2] for r in rows])
    whole, parted = np.zeros((3, 2, BUCKETS)), np.zeros((3, 2, BUCKETS))
    folds = np.arange(1200) % 3
    count(block_of(texts, y, folds, [None] * 1200), whole)
    for at in range(0, 1200, 70):
        count(block_of(texts[at : at + 70], y[at : at + 70], folds[at : at + 70], [None] * 70), parted)
    assert (whole == parted).all() and whole[:, 1, 0].sum() == 240 and whole[:, :, 0].sum() == 1200
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int, lang string").repartition(6)
    net = train(docs, docs.select("doc_id", "toxic"), shard_rows=300)
    assert np.mean((Scorer(net).scores(texts) >= 0.3) == (y == 1)) >= 0.97 and set(net.thresholds) == {"", "en"}
    a, b = calibrated_line(np.array([-2.0, -1, 1, 2]), np.array([0, 1, 0, 1.0]), np.array([5.0, 1, 1, 5]))
    z = np.repeat([-2.0, -1, 1, 2], [5, 1, 1, 5])
    assert (a, b) == pytest.approx(calibrated_line(z, np.repeat([0, 1, 0, 1.0], [5, 1, 1, 5])))


def test_passes_over_one_shard_stay_in_its_task(spark, monkeypatch):
    """Six passes over a small table bring the driver five networks once, and no learners go out; they used to do both after each pass."""
    import pickle

    from pyspark import SparkContext

    from rivulet.llm import toxicity

    got, sent, combined, broadcast = [], [], toxicity.combined, SparkContext.broadcast

    def taken(rows, mean):
        out = combined(rows, mean)
        got.append(sum(x.nbytes for x in out.values()))
        return out

    monkeypatch.setattr(toxicity, "combined", taken)
    monkeypatch.setattr(SparkContext, "broadcast", lambda self, value: (sent.append(len(pickle.dumps(value))), broadcast(self, value))[1])
    rows = [(i, f"calm{i % 97} day{i % 89}" + (" venomous" if i % 5 == 0 else " sunny"), int(i % 5 == 0)) for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.passes_of(600) == toxicity.MOST_PASSES
    net = toxicity.train(docs, docs.select("doc_id", "toxic"))
    assert np.mean((Scorer(net).scores([r[1] for r in rows]) >= 0.3) == np.array([r[2] == 1 for r in rows])) >= 0.99
    network, counts = 4 * toxicity.BUCKETS * toxicity.DIMENSIONS, 8 * 4 * 2 * toxicity.BUCKETS
    assert len(got) == 2 and sum(got) < counts + 5.1 * network
    assert sum(sent) < 1.1 * counts + 4.1 * network


def test_learners_go_on_from_their_numbers(spark):
    """All numbers bring back a learner, those of the network alone its scores; each pass of a task gets each block, in order."""
    import pickle

    import pyarrow as pa

    from rivulet.llm.toxicity import BUCKETS, Learner, block_of, count, passes

    texts, y = [f"calm{i % 7} day" + (" venomous" if i % 5 == 0 else "") for i in range(90)], (np.arange(90) % 5 == 0).astype(np.float32)
    blocks = [block_of(texts[at : at + 30], y[at : at + 30], np.zeros(30), [None] * 30) for at in (0, 30, 60)]
    batches = lambda: iter([pa.RecordBatch.from_arrays([pa.array([pickle.dumps(b) for b in own], pa.binary())], ["block"]) for own in (blocks[:2], blocks[2:])])
    for turns in (range(1), range(2, 3), range(3)):
        seen = list(passes(batches(), turns))
        assert [t for t, _ in seen] == [t for t in turns for _ in blocks]
        assert all((b.rows == blocks[i % 3].rows).all() and (b.labels == blocks[i % 3].labels).all() for i, (_, b) in enumerate(seen))
    assert list(passes(iter([]), range(3))) == []
    counts = np.zeros((1, 2, BUCKETS))
    for b in blocks:
        count(b, counts)
    one, two, three = (Learner(counts[0]) for _ in range(3))
    one.through(blocks[0], np.arange(30), np.random.default_rng(3))
    two.take(one.numbers(whole=True).astype(np.float32))
    three.take(one.numbers(whole=False).astype(np.float32))
    assert np.allclose(Scorer(one.net).margins(texts), Scorer(three.net).margins(texts), atol=1e-5)
    for x in (one, two):
        x.through(blocks[1], np.arange(30), np.random.default_rng(4))
    assert np.allclose(one.numbers(whole=True), two.numbers(whole=True), atol=1e-5)


def test_parts_of_odd_words():
    """Buckets of whole words and of their beginnings, against one word at a time."""
    from xxhash import xxh3_64_intdigest

    from rivulet.llm.toxicity import BEGINNINGS, BUCKETS, N_PARTS, parts
    from rivulet.llm.words import bare

    words = ["a", "abc", "ABCD,", "...", "漢字漢字漢字漢字", "Straße\x00end", "🙂🙂🙂🙂", "éa" * 9, "x" * 3000, "İstanbul"]
    hashed = lambda x, k: 1 + xxh3_64_intdigest(x.encode(), k) % (BUCKETS - 1)
    plain = [[hashed(b, 0) if b else 0] + [hashed(b[:k], k) if len(b) > k else 0 for k in BEGINNINGS] for b in map(bare, words)]
    assert parts(words)[0].tolist() == plain and parts([])[0].shape == (0, N_PARTS)
