"""Quantiles of raw values at any level from sketches by zone and day: raw rows are read once.

A KLL sketch of each zone's day is stored with its count; districts, the city and spans of days are
merged from these rows, which don't grow with the observations. Sketches are made, merged and asked
by Spark's own aggregates. `rank_error(k)`: a quantile's true rank lies within it, with a chance of
99 %, whatever was merged. The exact percentile by cell (ensemble_interval) stays for small groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K = 1000
#: Levels that sketches are merged to: zones, districts (-1 as zone) and the city (ALL as district).
LEVELS = ("zone", "district", "city")
#: Quantiles by which a share between two values is counted.
GRID = 500


def rank_error(k: int = K) -> float:
    """Normalised rank error of one quantile at 99 % confidence, as published for KLL sketches."""
    return 2.296 / k**0.9723


def quantile_sketches(obs: DataFrame, k: int = K) -> DataFrame:
    """zone_id, valid_date, n, sketch of the finite values of each zone and day; partial sketches are made before the shuffle."""
    known = obs.where(F.col("ts").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"))
    return known.groupBy("zone_id", F.to_date("ts").alias("valid_date")).agg(F.count("*").alias("n"), F.kll_sketch_agg_double(F.col("value").cast("double"), k).alias("sketch"))


def merged_sketches(sketches: DataFrame, zone: DataFrame) -> DataFrame:
    """level, district, zone_id, n, sketch of each zone, each district and the city, over all days of `sketches`.

    Zones are merged first, so each further level merges a row a zone.
    """
    merge = [F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch")]
    zones = sketches.groupBy("zone_id").agg(*merge).join(zone.select("zone_id", F.col("district_name").alias("district")), "zone_id")
    rows = lambda level, df: df.select(F.lit(level).alias("level"), "district", "zone_id", "n", "sketch")
    none = F.lit(-1).cast("int").alias("zone_id")
    districts = zones.groupBy("district").agg(*merge).select("district", none, "n", "sketch")
    city = zones.groupBy().agg(*merge).where("n > 0").select(F.lit("ALL").alias("district"), none, "n", "sketch")
    return rows("zone", zones).unionByName(rows("district", districts)).unionByName(rows("city", city))


def at(q: float) -> Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(q))


def sketch_intervals(merged: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """level, district, zone_id, n, lo, mid, hi of merged sketches."""
    return merged.select("level", "district", "zone_id", "n", at(lo).alias("lo"), at(0.5).alias("mid"), at(hi).alias("hi"))


def sketch_coverage(sketches: DataFrame, zone: DataFrame, cut: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """level, district, zone_id, n, coverage, width: the share of the values from the cut on that lie in the interval of those before it.

    Both come from the sketches: the interval from the merged early days, the share from GRID quantiles
    of the late ones, which adds half a step of the grid to the rank error. A level without early days has no row.
    """
    day = F.lit(cut).cast("date")
    key = ["level", "district", "zone_id"]
    early = sketch_intervals(merged_sketches(sketches.where(F.col("valid_date") < day), zone), lo, hi).select(*key, "lo", "hi")
    late = merged_sketches(sketches.where(F.col("valid_date") >= day), zone).join(early, key)
    grid = F.kll_sketch_get_quantile_double("sketch", F.array(*(F.lit((i + 0.5) / GRID) for i in range(GRID))))
    inside = late.select(*key, "n", "lo", "hi", grid.alias("grid")).withColumn("inside", F.size(F.filter("grid", lambda x: (x >= F.col("lo")) & (x <= F.col("hi")))))
    return inside.select(*key, "n", (F.col("inside") / F.lit(GRID)).alias("coverage"), (F.col("hi") - F.col("lo")).alias("width"))
