"""Near-duplicate documents: MinHash bands propose pairs, odd sketches screen them, full shingle sets confirm them.

A document's set holds the distinct n-word shingles of its whole text (A-Z
lowered, words between ASCII white space); a text of fewer words is one
shingle. Two documents are linked if

    100 * |intersection| >= percent * |union|.

Steps, each a Spark job over all documents:

1. one scan makes set size, a 128-bit digest of the set, the MinHash samples and
   the odd sketch, written once;
2. documents with equal sets are one class; only its smallest id goes on;
3. every band of MinHash samples is a bucket; each member is paired with the
   bucket's hub (a star, so a bucket of m gives m - 1 pairs);
4. of the pairs of small buckets those whose odd sketches, or sizes, differ far too much go; the
   others are confirmed on full sets, made again from the texts of the documents concerned;
5. links become components by star contraction;
6. members of the hub's component that can't be linked to any other member of the
   bucket, by what both share with the hub, leave it; buckets whose members still
   are in several components get another round of stars with other hubs;
7. what remains gives the pairs across components: small buckets all of them; the
   members of large ones those that share a rare shingle, by a prefix filter which loses
   no linked pair, so that texts which only share a passage part ways; these pass the same
   screen, full sets decide, and the new links join the components.

The odd sketch of a document sets the parity of 512 bits by its MinHash samples;
the number of differing bits of two sketches estimates how many samples differ.
It drops pairs only below `screen` (by default 0.2 less than the threshold, about
five standard deviations; 0 drops none), as full sets decide.

With 48 bands of 6 out of 128 samples, which all bands share, a pair at similarity 0.8
meets in no band with a probability of about 6e-5, one at 0.85 with about 1e-6 to 4e-6. `exact` puts all documents through the prefix filter
after the rounds of stars, at the cost of a join on rare shingles, and loses none.

Null texts, and texts without words, have an empty set and are linked with
nothing. A null id is returned with itself as component (null) and kept. Rows
with the same id are one document: its versions share a component. Extra columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, discard, materialize, quoted, slices, unused

SAMPLES, BANDS, BAND_ROWS, SKETCH_WORDS = 128, 48, 6, 8
#: Buckets up to this size give all pairs across components. The members of larger ones go through a prefix filter, whose
#: order of shingles comes from counts in so many cells.
SMALL_BUCKET, RARITY_CELLS = 16, 1 << 18
#: The star pairs of buckets up to this size are screened by odd sketches before full sets.
SCREENED_BUCKET = 4
#: Rounds of stars, each with other hubs. What a text shares with the hub tells which other texts it can't be linked with.
ROUNDS = 2
CACHE_ROWS = 100_000
#: Up to so many ids, those whose sets are wanted are broadcast to the scan of the texts; more are joined by a shuffle.
BROADCAST_IDS = 250_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: spreads every input bit over the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def constants(seed: int, n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


class Shingler:
    """Sets of shingle hashes of texts; hashes of frequent words are remembered within a bound."""

    def __init__(self, n: int):
        from xxhash import xxh3_64_intdigest

        self.n, self.hash, self.seen = n, xxh3_64_intdigest, {}

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit hashes of the text's shingles."""
        words = text.encode().lower().split()
        if not words:
            return np.zeros(0, np.uint64)
        seen = self.seen
        try:
            hashes = [seen[w] for w in words]
        except KeyError:
            if len(seen) > CACHE_ROWS:
                seen.clear()
            for w in words:
                if w not in seen:
                    seen[w] = self.hash(w)
            hashes = [seen[w] for w in words]
        h = np.array(hashes, np.uint64)
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, n, np.uint64)
        for k in range(n):
            out = mix(out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - n + 1 + k])
        return np.unique(out)


XOR, MULTIPLY = constants(11, SAMPLES)[:, None], constants(23, SAMPLES)[:, None] | np.uint64(1)


def min_hashes(shingles: np.ndarray) -> np.ndarray:
    """The upper 32 bits of the least value of each of the hash functions over the set."""
    least = np.full(SAMPLES, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(shingles), 512):
        part = (shingles[start : start + 512][None, :] ^ XOR) * MULTIPLY
        np.minimum(least, part.min(axis=1), out=least)
    return (least >> np.uint64(32)).astype(np.uint32).view(np.int32)


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Bit i is the parity of how many (function, sample) pairs hash to i."""
    bits = mix(samples.view(np.uint32).astype(np.uint64) * np.uint64(SAMPLES) + np.arange(SAMPLES, dtype=np.uint64)) % np.uint64(64 * SKETCH_WORDS)
    parity = np.bincount(bits.astype(np.int64), minlength=64 * SKETCH_WORDS) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view("<i8")


def bits_expected(similarity: float) -> int:
    """Differing sketch bits that a pair of this similarity shows on average."""
    size = 64 * SKETCH_WORDS
    return int(np.ceil(size / 2 * (1 - (1 - 2 / size) ** (2 * SAMPLES * (1 - similarity)))))


def packed(shingles: np.ndarray) -> bytes:
    """The lower 48 bits of each hash, enough to compare two sets."""
    return shingles.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpacked(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def ids_and_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles, digest of the set (h1, h2), samples, sketch. One scan."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in slices(batches, "text"):
            rows = []
            for text in b.column("text").to_pylist():
                s = shingler.shingles(text or "")
                if len(s):
                    m = min_hashes(s)
                    h1, h2 = int(mix(s + np.uint64(1)).sum(dtype=np.uint64)), int(mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64))
                    rows.append((len(s), h1, h2, m, odd_sketch(m)))
                else:
                    rows.append((0, 0, 0, None, None))
            size, h1, h2, m, sketch = zip(*rows, strict=True)
            as_long = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(size, pa.int64()), as_long(h1), as_long(h2), pa.array(m, pa.list_(pa.int32())), pa.array(sketch, pa.list_(pa.int64()))],
                ["doc_id", "n_shingles", "h1", "h2", "samples", "sketch"],
            )

    return arrow_map(ids_and_texts(docs), run, "doc_id long, n_shingles long, h1 long, h2 long, samples array<int>, sketch array<long>")


def full_sets(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """id, shingles (packed) of the documents whose id is in ids."""
    ids = materialize(ids.distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    wanted = ids_and_texts(docs).join(F.broadcast(ids) if few else ids, F.col("doc_id") == F.col("id"), "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(n)
        for b in slices(batches, "text"):
            sets = [packed(shingler.shingles(t or "")) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(sets, pa.binary())], ["id", "shingles"])

    sets = materialize(arrow_map(wanted, run, "id long, shingles binary"), "sets")
    discard(ids)
    return sets


def picks(seed: int, n: int) -> list[list[int]]:
    """n fixed, pseudorandom choices of BAND_ROWS samples."""
    rng = np.random.default_rng(seed)
    return [rng.choice(SAMPLES, BAND_ROWS, replace=False).tolist() for _ in range(n)]


def band_keys() -> F.Column:
    """An array of one key for each band."""
    return F.array(*(F.xxhash64(F.lit(k), *(F.col("samples")[i] for i in own)) for k, own in enumerate(picks(1000, BANDS))))


def with_hubs(members: DataFrame, turn: int) -> DataFrame:
    """The rows whose key has several ids, with the key's hub: its least id, later the least id of the component of least id.

    That component is most likely the largest one of the bucket. As the order of ids is
    the same in all buckets, a document meets few different hubs.
    """
    order = F.struct("component", "id") if turn else F.struct("id")
    hubs = members.groupBy("key").agg(F.min(order).alias("h"), F.min("id").alias("_a"), F.max("id").alias("_b"), F.count("*").alias("size")).where("_a < _b")
    return members.select("key", "id", "band").join(hubs.select("key", "size", F.col("h.id").alias("hub")), "key")


def screened(pairs: DataFrame, nodes: DataFrame, percent: int, screen: float) -> DataFrame:
    """The pairs (a, b) without those whose sizes or odd sketches differ too much."""
    light = nodes.select("id", "n_shingles", "sketch")
    side = lambda x: light.select(F.col("id").alias(x), F.col("n_shingles").alias("n_" + x), F.col("sketch").alias("s_" + x))
    differ = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x.cast("int"))
    sizes_fit = 100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b")
    close = sizes_fit & (differ <= bits_expected(screen)) if screen > 0 else sizes_fit
    return pairs.join(side("a"), "a").join(side("b"), "b").where(close).select("a", "b").distinct()


def compared(pairs: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b), each once, with both sizes, the number of shingles that they share, and whether they are linked, from the full sets.

    An id with several versions gives a row for each pair of versions.
    """
    pairs = materialize(pairs, "pairs")
    sets = full_sets(docs, pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))), n)
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "x"):
            counts, ok = [], []
            for x, y in zip(b.column("x"), b.column("y"), strict=True):
                p, q = unpacked(x.as_py()), unpacked(y.as_py())
                counts.append((len(p), len(q), len(np.intersect1d(p, q, assume_unique=True))))
                ok.append(100 * counts[-1][2] >= percent * (counts[-1][0] + counts[-1][1] - counts[-1][2]))
            n_a, n_b, common = zip(*counts, strict=True)
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), *(pa.array(v, pa.int64()) for v in (n_a, n_b, common)), pa.array(ok)], ["a", "b", "n_a", "n_b", "common", "linked"])

    found = materialize(arrow_map(both, run, "a long, b long, n_a long, n_b long, common long, linked boolean"), "compared")
    discard(pairs, sets)
    return found


def star_pairs(buckets: DataFrame, nodes: DataFrame, percent: int, screen: float) -> DataFrame:
    """The pairs (a, b) of hubs and members that full sets have to confirm, each once.

    Those of buckets of up to SCREENED_BUCKET members pass the screen first: what it drops leaves a few
    pairs, all of which `across` gives later. In a larger bucket full sets tell what each member
    shares with the hub, by which most of its pairs are settled.
    """
    pairs = buckets.where("id <> hub").groupBy(F.col("hub").alias("a"), F.col("id").alias("b")).agg(F.max("size").alias("size"))
    pairs = materialize(pairs, "star-pairs")
    large = pairs.where(F.col("size") > SCREENED_BUCKET).select("a", "b")
    return large.union(screened(pairs.where(F.col("size") <= SCREENED_BUCKET).select("a", "b"), nodes, percent, screen))


def linked(pairs: DataFrame) -> DataFrame:
    return pairs.where("linked").select("a", "b").distinct()


def unproven(members: DataFrame, stars: DataFrame, percent: int) -> DataFrame:
    """Members (key, id, band, component) of buckets in several components, without those that need no comparison.

    A member m of the hub's component shares with an outsider o at most what o shares
    with the hub and what m has beyond the hub. Where that is too little for a link with
    any outsider of the bucket, m leaves it. Of a pair that wasn't compared nothing is known.
    """
    t = percent / (100 + percent)
    versions = stars.groupBy(F.col("a").alias("hub"), F.col("b").alias("id")).agg(
        # With several versions of a document the bounds are those of the worst.
        F.max(F.col("common") - t * F.col("n_b")).alias("shared"), F.max(F.col("n_b") - F.col("common") - t * F.col("n_b")).alias("beyond")
    )
    rows = members.join(versions, ["hub", "id"], "left")
    hub_component = F.max(F.when(F.col("id") == F.col("hub"), F.col("component")))
    of_key = members.groupBy("key").agg(hub_component.alias("hub_component"), F.min("component").alias("_c"), F.max("component").alias("_d")).where("_c < _d").select("key", "hub_component")
    rows = materialize(rows.join(of_key, "key").withColumn("outside", F.col("component") != F.col("hub_component")), "bounds")
    closest = rows.where("outside").groupBy("key").agg(F.max(F.coalesce("shared", F.lit(float("inf")))).alias("closest"))
    # The hub itself has nothing beyond the hub, and has been compared to all.
    can = F.col("outside") | ((F.col("id") != F.col("hub")) & (F.coalesce("beyond", F.lit(float("inf"))) + F.col("closest") >= -1e-6))
    left = materialize(rows.join(closest, "key").where(can).select("key", "id", "band", "component"), "members")
    discard(rows)
    return left


def components(links: DataFrame) -> DataFrame:
    """id, component (the least id reachable) of every id in the links (a, b), by star contraction.

    Each round links every id's larger neighbours, then its smaller ones, to its
    least neighbour, until nothing changes: rounds grow with the logarithm of the
    longest path. Joins are on an id, with one row an id on one side, so Spark
    splits a hub's rows.
    """
    if links.isEmpty():
        return links.select(F.col("a").alias("id"), F.col("b").alias("component"))
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    known = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        before, edges = edges, materialize(small, "edges")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == known:
            break
        known = now
    return materialize(edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(edges.select("v", F.col("v").alias("component")).distinct()), "components")


def rarity(sets: DataFrame) -> np.ndarray:
    """How many of the sets hold a shingle of each cell; a shingle's cell is its hash modulo RARITY_CELLS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(RARITY_CELLS, np.int64)
        for b in slices(batches, "shingles"):
            for x in b.column("shingles"):
                counts += np.bincount((unpacked(x.as_py()) % np.uint64(RARITY_CELLS)).astype(np.int64), minlength=RARITY_CELLS)
        cells = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts[cells])], ["cell", "n"])

    found = arrow_map(sets.select("shingles"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(RARITY_CELLS, np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out


def prefix_pairs(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (id, component) of several components, with all that are linked: an exact prefix filter.

    Shingles have one order, rare ones first (any order is exact; this one keeps a
    common passage out of the prefixes). A set of s shingles shares at least percent of
    them with any set that it's linked with, so two linked sets share a shingle among the
    first s - percent * s + 1 of each. At the first that they share, at places i and j,
    they have at most the smaller of s_a - i and s_b - j in common, which must do for a link.
    """
    sets = materialize(full_sets(docs, members.select("id"), n).join(members, "id"), "sets")
    shared = docs.sparkSession.sparkContext.broadcast(rarity(sets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for b in slices(batches, "shingles"):
            for i, c, x in zip(b.column("id").to_pylist(), b.column("component").to_pylist(), b.column("shingles"), strict=True):
                s = unpacked(x.as_py())
                often = counts[(s % np.uint64(RARITY_CELLS)).astype(np.int64)]
                first = np.lexsort((s, often))[: len(s) + percent * len(s) // -100 + 1]
                # A cell that one set has a shingle in holds nothing that two sets share.
                places = np.flatnonzero(often[first] > 1)
                m = len(places)
                if m:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(m, v, np.int64)) for v in (i, c, len(s))] + [pa.array(len(s) - places), pa.array(s[first[places]].astype(np.int64))],
                        ["id", "component", "size", "most", "shingle"],
                    )

    rows = materialize(arrow_map(sets, run, "id long, component long, size long, most long, shingle long").distinct(), "prefixes")
    side = lambda x: rows.select("shingle", F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("component", "size", "most")))
    enough = F.expr(f"{100 + percent} * least(most_a, most_b) >= {percent} * (size_a + size_b)")
    return side("a").join(side("b"), "shingle").where(F.expr("a < b and component_a <> component_b") & enough).select("a", "b").distinct()


def across(members: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of members (key, id, band, component) that share a key but no component.

    Small buckets give all their pairs. The members of large ones give those that an
    exact prefix filter leaves, so that no linked pair is lost at any size of bucket.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("n"), F.min("component").alias("_c"), F.max("component").alias("_d")).where("_c < _d").select("key", "n")
    members = materialize(members.join(sizes, "key"), "members")
    small = members.where(F.col("n") <= SMALL_BUCKET)
    left = small.select("key", F.col("id").alias("a"), F.col("component").alias("_c"))
    found = left.join(small.select("key", F.col("id").alias("b"), F.col("component").alias("_d")), "key").where("a < b and _c <> _d").select("a", "b").distinct()
    large = materialize(members.where(F.col("n") > SMALL_BUCKET).select("id", "component").distinct(), "large")
    if large.isEmpty():
        return found
    return found.union(prefix_pairs(large, docs, n, percent)).distinct()


def near_duplicates(docs: DataFrame, shingle_words: int = 5, percent: int = 80, screen: float | None = None, exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id, kept (doc_id is the component's least id) of each row of docs; exact: by no chance of the bands."""
    screen = percent / 100 - 0.2 if screen is None else screen
    screen = 0.0 if exact else screen
    table = materialize(signatures(docs, shingle_words), "signatures")
    filled = table.where("doc_id is not null and n_shingles > 0")
    keys = ["h1", "h2", "n_shingles"]
    classes = materialize(filled.groupBy(keys).agg(F.min("doc_id").alias("id")), "classes")
    # One row a class; the join is on the ids, which are spread evenly however many copies a class has.
    nodes = filled.withColumnRenamed("doc_id", "id").join(classes, ["id", *keys]).dropDuplicates(["id", *keys])
    nodes = materialize(nodes.select("id", "n_shingles", "samples", "sketch"), "nodes")
    compare = lambda pairs: compared(pairs, docs, shingle_words, percent)
    # Rows with one id and different sets are versions of one document.
    several = filled.groupBy("doc_id").agg(F.min("h1").alias("x"), F.max("h1").alias("y")).where("x < y").select("doc_id")
    versions = filled.select("doc_id", *keys).join(several, "doc_id", "left_semi").join(classes, keys).where("doc_id <> id")
    links = materialize(versions.select(F.col("doc_id").alias("a"), F.col("id").alias("b")).distinct(), "links")
    members = nodes.select("id", F.posexplode(band_keys()).alias("band", "key"))
    for turn in range(ROUNDS):
        buckets = materialize(with_hubs(members, turn), "buckets")
        stars = compare(star_pairs(buckets, nodes, percent, screen))
        links = materialize(links.union(linked(stars)).distinct(), "links")
        found = components(links)
        members = unproven(buckets.join(found, "id", "left").withColumn("component", F.coalesce("component", "id")), stars, percent)
        if members.isEmpty():
            break
    if exact:
        rest = nodes.select("id").distinct().join(found, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
        more = prefix_pairs(rest, docs, shingle_words, percent)
    else:
        more = across(members, docs, shingle_words, percent)
    more = materialize(linked(compare(screened(more, nodes, percent, screen))), "links")
    if not more.isEmpty():
        found = components(links.union(more))
    of_class = classes.join(found, "id", "left").select(*keys, F.coalesce("component", "id").alias("component_id"))
    out = table.select("doc_id", *keys).join(of_class, keys, "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).alias("component_id"))
    out = out.withColumn("component_id", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def deduplicated(docs: DataFrame, shingle_words: int = 5, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates: that of the least id. All columns stay as they were.

    Rows that repeat an id count as one group, too; documents without words and
    rows without an id all stay.
    """
    found = materialize(near_duplicates(docs, shingle_words, percent), "decisions").where("doc_id is not null and n_shingles > 0")
    key, whole = unused("id", docs), unused("row", docs)
    ids = lambda rows: rows.select(F.col("doc_id").alias(key)).distinct()
    dropped, repeated = ids(found.where("not kept")), ids(found.groupBy("doc_id").count().where("count > 1"))

    def joined(rows: DataFrame, keys: DataFrame, how: str) -> DataFrame:
        keys = F.broadcast(keys) if keys.count() <= BROADCAST_IDS else keys
        return rows.join(keys, F.col("doc_id").cast("long") == F.col(key), how)

    kept = joined(docs, dropped, "left_anti")
    if repeated.isEmpty():
        return kept
    # An aggregate, as one id may be that of many rows.
    order = F.struct(F.xxhash64("text"), F.col("text"), F.xxhash64(*quoted(docs, [c for c, kind in docs.dtypes if "map<" not in kind])))
    ones = joined(kept, repeated, "left_semi").where(F.col("text").isNotNull()).groupBy(F.col("doc_id").alias(key)).agg(F.min_by(F.struct(*quoted(docs)), order).alias(whole)).select(f"{whole}.*")
    return joined(kept, repeated, "left_anti").unionByName(ones)
