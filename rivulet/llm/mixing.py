"""Mixing sources to target weights by fixed-length blocks, multinomial shards and index permutations.

The words of each source, document after document, are cut into blocks of
`block_words` words. A source's share of the output is a number of slots. Output
shards of `shard_slots` slots draw how many slots each source gets: multinomial
draws, conditioned on the sources' totals (a plain multinomial would miss the
targets by its noise on small inputs), made by a pseudorandom permutation of all slots,
so that one law holds at any size. The i-th slot of a source takes the block
that a pseudorandom permutation of the source's block indexes gives for i; each
further pass over the blocks has its own permutation. Slots and blocks meet in a
join on (source, block).

Targets: sources by code point, null last, with the weights repeating, share
`total_share` times all words; a target stops at `most_passes` times its source's
words and the excess is shared anew by weight until none is above.

A null text has 0 words; documents without words take 0. Null ids and sources
are values like others. Repeated rows are separate documents that follow each
other, each with words of its own. Extra columns are ignored; an empty table gives an
empty table. The table of sources (a few numbers each) is held on the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, arrow_map, materialize, quoted, slices, unused

#: Up to so many sources, the table of sources (a few numbers each) is broadcast.
BROADCAST_SOURCES = 50_000
BATCH = 65_536


def targets(sizes: list[int], weights: tuple[int, ...] = (3, 1, 2), total_share: float = 1.5, most_passes: int = 2) -> list[float]:
    """Words that each source should give; sizes in the order of the sources."""
    own = [weights[i % len(weights)] for i in range(len(sizes))]
    left, free, out = total_share * sum(sizes), set(range(len(sizes))), [0.0] * len(sizes)
    while free:
        scale = left / sum(own[i] for i in free)
        above = [i for i in sorted(free) if own[i] * scale > most_passes * sizes[i]]
        for i in above or sorted(free):
            out[i] = float(most_passes * sizes[i]) if above else own[i] * scale
        left -= sum(out[i] for i in above)
        free = free - set(above) if above else set()
    return out


def slots_for(size: int, target: float, block: int, most_passes: int) -> int:
    """How many slots bring a source closest to its target: whole passes, then full blocks."""
    if not size:
        return 0
    blocks = -(-size // block)
    passes, rest = divmod(target, size)
    return min(most_passes * blocks, int(passes) * blocks + min(blocks, round(rest / block)))


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1: four Feistel rounds on the next larger square domain, walked until below n."""
    half = np.uint64(max(1, (max(1, n - 1).bit_length() + 1) // 2))
    low = (np.uint64(1) << half) - np.uint64(1)
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        left, right = out[todo] >> half, out[todo] & low
        for r in range(4):
            x = (right + np.uint64((key + r * 0x9E3779B97F4A7C15) % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
            left, right = right, left ^ ((x >> np.uint64(32)) & low)
        out[todo] = left << half | right
        todo = todo[out[todo] >= np.uint64(n)]
    return out.astype(np.int64)


def sources_of(totals: np.ndarray, slots: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Source of each of the output's slots, and the slot's number within its source.

    A pseudorandom permutation of all slots, read as source after source: the counts that
    a range of slots gets are multinomial draws conditioned on the totals, whatever
    the totals are, and all shards agree without meeting.
    """
    place = permuted(slots, int(totals.sum()), seed)
    ends = np.cumsum(totals)
    source = np.searchsorted(ends, place, "right")
    return source, place - (ends - totals)[source]


class Mix:
    """The plan of a mixture: documents placed in their sources, and the slots of the output.

    row: a column of docs that numbers its rows, each with another number; without it rows are numbered here.
    """

    def __init__(self, docs: DataFrame, weights=(3, 1, 2), total_share=1.5, most_passes=2, block_words=64, shard_slots=1 << 16, seed=7, rows_per_chunk=4_000, row: str | None = None):
        self.spark, self.block, self.shard_slots, self.seed = docs.sparkSession, block_words, shard_slots, seed
        text = F.coalesce(F.col("text").cast("string"), F.lit(""))
        number = F.monotonically_increasing_id() if row is None else F.col(row)
        sized = docs.select(
            number.alias("__row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
            F.xxhash64("text").alias("text_hash"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        )
        sized = materialize(sized, "sized")
        sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("rows")).collect()
        sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
        sizes = [r["size"] for r in sources]
        self.sizes, self.passes = sizes, most_passes
        self.targets = targets(sizes, weights, total_share, most_passes)
        self.slots = np.array([slots_for(s, t, block_words, most_passes) for s, t in zip(sizes, self.targets, strict=True)], np.int64)
        rows = [(i, r["source"], r["size"], t) for i, (r, t) in enumerate(zip(sources, self.targets, strict=True))]
        table = self.spark.createDataFrame(rows, "source_index int, _source string, source_size long, target double")
        table = F.broadcast(table) if len(rows) <= BROADCAST_SOURCES else table
        of_source = sized.join(table, F.col("source").eqNullSafe(F.col("_source"))).drop("_source", "source")
        self.empty = of_source.where("size = 0")
        self.placed = self.place(of_source.where("size > 0"), max(1, sum(r["rows"] for r in sources) // rows_per_chunk))

    def place(self, rows: DataFrame, chunks: int) -> DataFrame:
        """Adds to each row where it starts among its source's words.

        Rows alike in id, text and source are copies; they are counted first, so that a
        class of any number of copies is one row here, and follow each other. Classes start within
        chunks of bounded size, chunk by chunk.
        """
        keys = ["source_index", "doc_id", "text_hash", "size", "source_size", "target"]
        classes = rows.groupBy(keys).agg(F.count("*").alias("copies"), F.min("__row").alias("__row"))
        classes = classes.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(chunks))).withColumn("words", F.col("size") * F.col("copies"))
        classes = materialize(classes, "classes")
        starts = classes.groupBy("source_index", "chunk").agg(F.sum("words").alias("n"))
        starts = starts.select("source_index", "chunk", (F.sum("n").over(Window.partitionBy("source_index").orderBy("chunk")) - F.col("n")).alias("chunk_start"))
        inside = F.sum("words").over(Window.partitionBy("source_index", "chunk").orderBy("doc_id", "text_hash").rowsBetween(Window.unboundedPreceding, 0)) - F.col("words")
        placed = classes.withColumn("inside", inside).join(starts, ["source_index", "chunk"])
        placed = materialize(placed.select("__row", *keys, "copies", (F.col("inside") + F.col("chunk_start")).alias("start")), "placed")
        single = placed.where("copies = 1").drop("copies")
        several = placed.where("copies > 1").drop("__row", "copies")
        if several.isEmpty():
            return single
        same = lambda a, b: a.join(b.toDF(*("_" + c for c in b.columns)), F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("text_hash") == F.col("_text_hash")) & (F.col("source_index") == F.col("_source_index")))
        of_class = several.select("source_index", "doc_id", "text_hash", "start")
        copies = same(rows, of_class).select("__row", *keys, F.col("_start").alias("start"), F.shiftright("__row", 20).alias("part"))
        # Copies are numbered by parts of a million row numbers at most, so no class is one task.
        copies = materialize(copies, "copies")
        parts = copies.groupBy("start", "source_index", "part").agg(F.count("*").alias("n"))
        before = parts.select("start", "source_index", "part", (F.sum("n").over(Window.partitionBy("source_index", "start").orderBy("part")) - F.col("n")).alias("before"))
        own = F.row_number().over(Window.partitionBy("source_index", "start", "part").orderBy("__row")) - 1
        numbered = copies.withColumn("own", own).join(before, ["start", "source_index", "part"])
        numbered = numbered.withColumn("start", F.col("start") + F.col("size") * (F.col("own") + F.col("before")))
        return single.unionByName(materialize(numbered.select(single.columns), "numbered"))

    def slot_blocks(self) -> DataFrame:
        """(source_index, block, times) of the blocks that the output takes."""
        totals, sizes, block, slots, seed = self.slots, np.array(self.sizes, np.int64), self.block, self.shard_slots, self.seed
        all_slots = int(totals.sum())
        shards = max(1, -(-all_slots // slots))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for shard in b.column("id").to_pylist():
                    if shard * slots >= all_slots:
                        continue
                    source, i = sources_of(totals, np.arange(shard * slots, min((shard + 1) * slots, all_slots)), seed)
                    out = np.empty_like(i)
                    by = np.argsort(source, kind="stable")
                    for s, own in zip(np.unique(source).tolist(), np.split(by, np.flatnonzero(np.diff(source[by])) + 1), strict=True):
                        blocks = -(-int(sizes[s]) // block)
                        for turn in np.unique(i[own] // blocks).tolist():
                            now = own[i[own] // blocks == turn]
                            out[now] = permuted(i[now] % blocks, blocks, seed + 1_000_003 * s + 7_919 * turn)
                    yield pa.RecordBatch.from_arrays([pa.array(source, pa.int32()), pa.array(out, pa.int64())], ["source_index", "block"])

        return arrow_map(self.spark.range(0, shards, 1, min(shards, 4096)), run, "source_index int, block long").groupBy("source_index", "block").agg(F.count("*").alias("times"))

    def document_blocks(self) -> DataFrame:
        """Every placed document's parts of blocks: first word in the document, number of words, times taken."""
        b = F.lit(self.block)
        stop = F.col("start") + F.col("size")
        parts = self.placed.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((stop - 1) / b))))
        from_word = F.greatest(F.col("start"), F.col("block") * b)
        parts = parts.withColumn("first_word", from_word - F.col("start")).withColumn("n_words", F.least(stop, (F.col("block") + 1) * b) - from_word)
        # Spark takes a generated table for tiny and would broadcast it; it grows with the input.
        return parts.join(self.slot_blocks().hint("merge"), ["source_index", "block"], "left").withColumn("times", F.coalesce("times", F.lit(0)))

    def taken(self) -> DataFrame:
        """doc_id, size, source_size, target, taken of every document."""
        keys = ["__row", "doc_id", "size", "source_size", "target"]
        out = self.document_blocks().groupBy(keys).agg(F.sum(F.col("n_words") * F.col("times")).alias("taken"))
        cols = ["doc_id", "size", "source_size", "target", "taken"]
        return out.select(cols).union(self.empty.withColumn("taken", F.lit(0).cast("long")).select(cols))


def mixed_documents(docs: DataFrame, **settings) -> DataFrame:
    """The mixture as documents with the columns of docs: one row for each document and pass, holding the words taken in it.

    Words that follow each other in the text keep the white space between them;
    parts that don't are joined by a line feed. n_chars, if there, is made anew. Rows
    are numbered and written once, as each of several copies takes words of its own.
    """
    row, spans_name = unused("row", docs), unused("spans", docs)
    numbered = materialize(docs.withColumn(row, F.monotonically_increasing_id()), "numbered-docs")
    parts = Mix(numbered, row=row, **settings).document_blocks().where("times > 0")
    spans = parts.groupBy(F.col("__row").alias(row)).agg(F.array_sort(F.collect_list(F.struct("first_word", "n_words", "times"))).alias(spans_name))
    joined = numbered.join(spans, row)
    names, schema = docs.columns, docs.schema
    cols = quoted(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        word = re.compile(WORD)
        for b in slices(batches, "text"):
            rows, texts = [], []
            for row, (text, spans) in enumerate(zip(b.column("text").to_pylist(), b.column(spans_name).to_pylist(), strict=True)):
                words = [m.span() for m in word.finditer(text)]
                for turn in range(1, max(s["times"] for s in spans) + 1):
                    runs: list[list[int]] = []
                    for s in (s for s in spans if s["times"] >= turn):
                        end = s["first_word"] + s["n_words"]
                        if runs and runs[-1][1] == s["first_word"]:
                            runs[-1][1] = end
                        else:
                            runs.append([s["first_word"], end])
                    rows.append(row)
                    texts.append("\n".join(text[words[i][0] : words[j - 1][1]] for i, j in runs))
            if not rows:
                continue
            picked = b.take(pa.array(rows))
            made = {"text": pa.array(texts, pa.string()), "n_chars": pa.array([len(t) for t in texts], pa.int64())}
            yield pa.RecordBatch.from_arrays([made[c].cast(picked.schema.field(c).type) if c in made else picked.column(c) for c in names], names)

    return arrow_map(joined.select(*cols, spans_name), run, schema)
