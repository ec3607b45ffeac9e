"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..sources.scratch import shared_dir

#: Words of a text are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage and outlives executors.

    The table goes when the application ends, or by `discard`.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    hadoop_path = jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    table = spark.read.schema(df.schema).parquet(path)
    table._rivulet_path = hadoop_path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `materialize` that nothing reads any more."""
    for t in tables:
        t._rivulet_path.getFileSystem(t.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(t._rivulet_path, True)


#: Rows and bytes of the Arrow batches between Spark and Python. Spark's own bounds (10,000 rows, 64 MB) times the
#: buffers on either side, and what Python makes of the rows, would be most of a small executor's memory.
BATCH_ROWS, BATCH_BYTES = 1_000, 1 << 20


def arrow_map(rows: DataFrame, run, schema) -> DataFrame:
    """rows.mapInArrow(run, schema) with batches of bounded size; smaller bounds of the session stay."""
    conf = rows.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = conf.get(f"spark.sql.execution.arrow.{name}").removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(f"spark.sql.execution.arrow.{name}", str(most))
    names = rows.columns
    if not any(c in name for name in names for c in ".`"):
        return rows.mapInArrow(run, schema)
    # Spark looks input columns up by their bare names, so odd names are put aside on the way.
    made = schema.fieldNames() if isinstance(schema, StructType) else None

    def renamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(x.rename_columns(names) for x in batches):
            yield b.rename_columns([f"c{i}" for i in range(len(made))]) if made else b

    plain = StructType([StructField(f"c{i}", f.dataType, f.nullable) for i, f in enumerate(schema)]) if made else schema
    out = rows.toDF(*(f"c{i}" for i in range(len(names)))).mapInArrow(renamed, plain)
    return out.toDF(*made) if made else out


def slices(batches: Iterator[pa.RecordBatch], column: str, max_bytes: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches so that `column` holds about max_bytes in each; a longer row comes alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.fromiter((len(x) if x is not None else 0 for x in (s.as_buffer() if s.is_valid else None for s in batch.column(column))), np.int64, batch.num_rows)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + max_bytes, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def is_training_row(doc_id: str = "doc_id"):
    """Rows from which labels may be learnt: crc32 of the id as text, mod 4, is not 2."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 != 2


def unused(name: str, frame: DataFrame) -> str:
    """The name, made longer until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(frame: DataFrame, columns: list[str] | None = None) -> list[F.Column]:
    """Columns by their whole names, whatever signs are in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns or frame.columns]


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """All labelled training documents: doc_id, text, lang (null if not there), _label.

    An id that several rows hold counts once, with the text of the least hash, and with the largest of its labels.
    """
    ids = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & is_training_row()).groupBy("doc_id").agg(F.max(label).cast("int").alias("_label"))
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    own = docs.where(F.col("doc_id").isNotNull() & is_training_row()).select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), lang.alias("lang")).join(ids, "doc_id")
    own = own.groupBy("doc_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("t"))
    return own.select("doc_id", "_label", "t.text", "t.lang")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, max_bytes: int = 64 << 20) -> DataFrame:
    """At most `rows` labelled training documents (doc_id, text, lang if there, _label), and `max_bytes` of texts.

    Ids that have a document are picked by a hash. An id that several rows hold counts once, with the text of
    the least hash. The sample of ids is bounded by `rows`, so it's broadcast to the scan of the texts;
    in the order of the hashes each text that still fits into `max_bytes` is taken, and one that doesn't is passed over.
    """
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & is_training_row())
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("_label"))
        .join(docs.select("doc_id"), "doc_id", "left_semi")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(rows)
    )
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    picked = docs.select("doc_id", text.alias("text"), lang.alias("lang")).join(F.broadcast(ids), "doc_id")
    picked = picked.groupBy("doc_id", "_label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "lang")).alias("t"))
    picked = materialize(picked.select("doc_id", "_label", "t.text", "t.lang"), "sample")
    # `rows` numbers at most.
    taken, total = [], 0
    for r in picked.select("doc_id", F.octet_length("text").alias("bytes")).orderBy(F.xxhash64("doc_id"), "doc_id").collect():
        if total + r.bytes <= max_bytes:
            total += r.bytes
            taken.append((r.doc_id,))
    within = docs.sparkSession.createDataFrame(taken, picked.select("doc_id").schema)
    return picked.join(F.broadcast(within), "doc_id")
