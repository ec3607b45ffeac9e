"""Daily means and zone features as tables partitioned by day, kept up by rewriting only the days that late events touch.

A late observation changes its day's means, and the features of that day and the seven after it.
`refresh` reads those observations and partitions alone and overwrites them; a run that is repeated
writes the same partitions again.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import exact
from ..operators.uncertainty import features_of_days

#: Days whose features look back at a day.
REACH = 7
DAILY = "zone_id int, sensor string, mean_value double, valid_date date"
FEATURES = "zone_id int, sensor string, mean_value double, lag_value double, week_mean double, valid_date date"


def overwrite(df: DataFrame, folder: str, kind: str) -> None:
    """Writes the partitions that df has rows of; others stay."""
    names = [c.split()[0] for c in kind.split(", ")]
    df.select(names).repartition("valid_date").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("valid_date").parquet(folder)


def on_days(days: list[dt.date], column: str = "valid_date"):
    """Whether the column's date is one of the days, as a range for a scan to push down and the days themselves."""
    return F.col(column).between(F.lit(min(days)), F.lit(max(days))) & F.col(column).isin(days)


def observed_on(obs: DataFrame, days: list[dt.date]) -> DataFrame:
    """Observations of the days; the range of times reaches the scan."""
    first, end = (dt.datetime.combine(d, dt.time()) for d in (min(days), max(days) + dt.timedelta(days=1)))
    return obs.where((F.col("ts") >= F.lit(first)) & (F.col("ts") < F.lit(end)) & F.to_date("ts").isin(days))


def build(obs: DataFrame, folder: str) -> None:
    """Both tables from all observations."""
    overwrite(daily_means(obs), f"{folder}/daily", DAILY)
    overwrite(features_of_days(daily(obs.sparkSession, folder)), f"{folder}/features", FEATURES)


def daily_means(obs: DataFrame) -> DataFrame:
    return obs.groupBy("zone_id", "sensor", F.to_date("ts").alias("valid_date")).agg(exact(F.avg("value")).alias("mean_value")).where("valid_date is not null")


def daily(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(DAILY).parquet(f"{folder}/daily")


def features(spark: SparkSession, folder: str) -> DataFrame:
    """The table of zone_features."""
    return spark.read.schema(FEATURES).parquet(f"{folder}/features").select("zone_id", "valid_date", "sensor", "mean_value", "lag_value", "week_mean")


def touched(days: list[dt.date]) -> list[dt.date]:
    """The days and the seven after each."""
    return sorted({d + dt.timedelta(days=k) for d in days for k in range(REACH + 1)})


def refreshed(spark: SparkSession, folder: str, days: list[dt.date]) -> DataFrame:
    """The features of the days that the given ones touch, from the daily means of those and the seven before."""
    changed = touched(days)
    window = F.col("valid_date").between(F.lit(min(changed) - dt.timedelta(days=REACH)), F.lit(max(changed)))
    return features_of_days(daily(spark, folder).where(window)).where(on_days(changed))


def refresh(obs: DataFrame, folder: str, days: list[dt.date]) -> None:
    """Brings both tables up to date after events of these days came late (obs: all observations, the late ones too)."""
    if not days:
        return
    overwrite(daily_means(observed_on(obs, sorted(set(days)))), f"{folder}/daily", DAILY)
    overwrite(refreshed(obs.sparkSession, folder, days), f"{folder}/features", FEATURES)
