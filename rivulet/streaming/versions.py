"""Versioned tables that one query writes and another reads, and which version each batch of a query has read.

A table of a version is written once, to a folder of its own, and never changed. A batch pins the
newest versions when it first runs; a replay of it reads the same ones, whatever came since.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession


def remove(spark: SparkSession, paths: list[str]) -> None:
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def complete(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the tables `folder/name=number` that are written whole."""
    jvm, path = spark.sparkContext._jvm, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    # A few folders, as older ones are removed.
    done = [s.getPath() for s in fs.listStatus(path) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    return sorted(int(p.getName().split("=")[1]) for p in done)


class Versions:
    """The versions of one table in a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def write(self, df: DataFrame, version: int) -> None:
        """A version that is there already stays as it is."""
        if version not in complete(self.spark, self.folder):
            df.write.mode("overwrite").parquet(f"{self.folder}/version={version}")

    def newest(self) -> int | None:
        return max(complete(self.spark, self.folder), default=None)

    def at(self, version: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/version={version}")

    def forget(self, before: int) -> None:
        """Removes versions below `before`, which no batch that may be replayed has pinned."""
        remove(self.spark, [f"{self.folder}/version={v}" for v in complete(self.spark, self.folder) if v < before])


def pinned(spark: SparkSession, folder: str, batch_id: int, tables: dict[str, Versions]) -> dict[str, int | None]:
    """The version of each table that the batch reads: the newest at its first run. None: the table has none yet.

    The pins are one small file, which is there whole or not at all.
    """
    jvm = spark.sparkContext._jvm
    path, fresh = (jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}={batch_id}") for name in ("batch", "_making"))
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        file = fs.create(fresh, True)
        file.write(bytearray(json.dumps({name: t.newest() for name, t in tables.items()}).encode()))
        file.close()
        fs.rename(fresh, path)
    file = fs.open(path)
    try:
        return json.loads(jvm.org.apache.commons.io.IOUtils.toString(file, "UTF-8"))
    finally:
        file.close()
