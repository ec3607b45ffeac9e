"""What the two vector searches share: which vectors take part, shards, query blocks and the best of all shards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def usable(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """vec_id, vector (array<double>) without null ids, null vectors and null or non-finite components.

    Rows that repeat an id count once; of different vectors under one id the least counts.
    """
    v = F.col(vector_column).cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("vector")).where(F.col("vec_id").isNotNull() & v.isNotNull() & finite)
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def dealt(rows: DataFrame, name: str, groups: int) -> DataFrame:
    """Adds a column with a group number from 0 to groups - 1, by a hash of the id."""
    return rows.withColumn(name, F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))


def every(rows: DataFrame, name: str, groups: int) -> DataFrame:
    """Each row once for each group number."""
    return rows.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))


def best(found: DataFrame, k: int) -> DataFrame:
    """The k highest scores of each query_id, ties to the smaller vec_id, ranked from 1."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
