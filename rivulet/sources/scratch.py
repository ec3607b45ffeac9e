"""Tables written once for plans that use them many times."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see.

    `spark.checkpoint.dir` where the session sets it; without it, on a cluster, the warehouse, if
    that isn't on the machines' own disks; in local mode a temporary folder.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if not hasattr(shared_dir, "own"):
            shared_dir.own = "file://" + tempfile.mkdtemp(prefix="rivulet-")
        return shared_dir.own
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if ":" not in warehouse or warehouse.startswith("file:"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{warehouse}/_rivulet"


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    return f"{shared_dir(spark)}/rivulet-{uuid.uuid4().hex}"


def held(df: DataFrame) -> DataFrame:
    """df as a table in a scratch folder, which goes when the application ends: outlives executors and needs no unpersist."""
    spark, path = df.sparkSession, scratch(df.sparkSession)
    df.write.parquet(path)
    hadoop_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop_path)
    return spark.read.schema(df.schema).parquet(path)
