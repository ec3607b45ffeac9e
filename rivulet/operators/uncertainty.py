"""Forecast input and the uncertainty of predictions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import entropy, exact, poisson_one, uniform

CELL = ["zone_id", "valid_date"]
PREDICTORS = ["lag_mean", "lag_max", "week_mean"]
DAY = "1970-01-01"


def zone_features(obs: DataFrame) -> DataFrame:
    """Mean of each zone, sensor and day; of the day before; of the seven days before (the day itself excluded)."""
    return features_of_days(obs.groupBy("zone_id", "sensor", F.to_date("ts").alias("valid_date")).agg(exact(F.avg("value")).alias("mean_value")))


def features_of_days(daily: DataFrame) -> DataFrame:
    """zone_features from zone_id, sensor, valid_date, mean_value."""
    daily = daily.withColumn("day_no", F.datediff("valid_date", F.lit(DAY).cast("date")))
    by_day = Window.partitionBy("zone_id", "sensor").orderBy("day_no")
    return daily.select(
        *CELL, "sensor", "mean_value", F.max("mean_value").over(by_day.rangeBetween(-1, -1)).alias("lag_value"), exact(F.avg("mean_value").over(by_day.rangeBetween(-7, -1))).alias("week_mean")
    )


def bagged_forecast(features: DataFrame, outcome: DataFrame, members: int = 5, cut: str = "2024-01-16", max_iter: int = 20) -> DataFrame:
    """Logistic models on bootstraps of the cells before `cut`; each scores the later cells: forecast_member rows.

    A bootstrap weighs each cell by a Poisson(1) count that depends on the cell and
    the member. Training runs in Spark's own distributed solver.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    cells = VectorAssembler(inputCols=PREDICTORS, outputCol="features").transform(predictors(features))
    cut_date = F.lit(cut).cast("date")
    early = cells.where(F.col("valid_date") < cut_date).join(outcome.select(*CELL, F.col("flooded").cast("double").alias("label")), CELL).persist()
    late = cells.where(F.col("valid_date") >= cut_date)
    scored = []
    for m in range(members):
        weighted = early.withColumn("weight", poisson_one(uniform(F.lit(m), "zone_id", "valid_date")).cast("double")).where("weight > 0")
        model = LogisticRegression(weightCol="weight", regParam=0.01, maxIter=max_iter).fit(weighted)
        p = vector_to_array(F.col("probability"))[1]
        scored.append(model.transform(late).select(*CELL, F.lit(f"bag{m}").alias("member"), F.round(p, 6).alias("prob"), "n_obs"))
    early.unpersist()
    return reduce(DataFrame.unionByName, scored)


def predictors(features: DataFrame) -> DataFrame:
    """A row for each cell with PREDICTORS, from the sensors whose day before and week before are known."""
    known = features.where("lag_value is not null and week_mean is not null")
    return known.groupBy(CELL).agg(F.avg("lag_value").alias("lag_mean"), F.max("lag_value").alias("lag_max"), F.avg("week_mean").alias("week_mean"), F.count("*").alias("n_obs"))


def bagged_newton(features: DataFrame, outcome: DataFrame, members: int = 5, cut: str = "2024-01-16", steps: int = 5, ridge: float = 0.01) -> DataFrame:
    """bagged_forecast with all members fitted at once: each Newton step is one aggregate, whatever their number.

    Cells before `cut` are weighted as in bagged_forecast, their predictors put to mean 0 and
    deviation 1 over them. A step sums every member's gradient and Hessian (14 numbers) over the
    cells; the sums of few rows, one a member, are solved on the driver. The penalty is
    `ridge` times the member's weight, on all coefficients but the constant. A member without any
    weight, and all without early cells, gives p = 0.5.
    """
    day = F.lit(cut).cast("date")
    cells = predictors(features)
    early = cells.where(F.col("valid_date") < day).join(outcome.select(*CELL, F.col("flooded").cast("double").alias("y")), CELL)
    scale = early.agg(*(f(c).alias(f"{name}_{c}") for c in PREDICTORS for name, f in (("mean", F.avg), ("sd", F.stddev_pop)))).first().asDict()
    # A predictor that doesn't vary says nothing.
    level = [F.lit(1.0)] + [(F.col(c) - F.lit(round(scale[f"mean_{c}"] or 0.0, 9))) / F.lit(round(scale[f"sd_{c}"] or 0.0, 9) or 1.0) for c in PREDICTORS]
    n = len(level)
    named = [x.alias(f"x{i}") for i, x in enumerate(level)]
    beta = np.zeros((members, n))

    def margin() -> Column:
        return sum((F.element_at(F.array(*(F.lit(float(b)) for b in beta[:, i])), F.col("m") + 1) * F.col(f"x{i}") for i in range(n)), F.lit(0.0))

    drawn = early.select(*CELL, "y", *named, F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("m"))
    drawn = drawn.withColumn("w", poisson_one(uniform("m", "zone_id", "valid_date")).cast("double")).where("w > 0").drop(*CELL).persist()
    pairs = [(i, j) for i in range(n) for j in range(i + 1)]
    try:
        for _ in range(steps):
            p = 1 / (1 + F.exp(-margin()))
            rows = drawn.withColumn("r", F.col("w") * (F.col("y") - p)).withColumn("h", F.col("w") * p * (1 - p))
            gradient = [F.sum(F.col("r") * F.col(f"x{i}")).alias(f"g{i}") for i in range(n)]
            hessian = [F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")).alias(f"h{i}{j}") for i, j in pairs]
            for row in rows.groupBy("m").agg(F.sum("w").alias("w"), *gradient, *hessian).collect():
                penalty = np.array([0.0] + [ridge * row["w"]] * (n - 1))
                h = np.zeros((n, n))
                for i, j in pairs:
                    h[i, j] = h[j, i] = row[f"h{i}{j}"]
                g = np.array([row[f"g{i}"] for i in range(n)]) - penalty * beta[row["m"]]
                beta[row["m"]] += np.linalg.solve(h + np.diag(penalty + 1e-9), g)
    finally:
        drawn.unpersist()
    late = cells.where(F.col("valid_date") >= day).select(*CELL, "n_obs", *named, F.explode(F.sequence(F.lit(0), F.lit(members - 1))).alias("m"))
    return late.select(*CELL, F.concat(F.lit("bag"), F.col("m")).alias("member"), F.round(1 / (1 + F.exp(-margin())), 6).alias("prob"), "n_obs")


def summary_columns() -> list[Column]:
    """The aggregates of ensemble_summary; members whose prob is null count as none."""
    members = F.count("prob")
    return [
        exact(F.avg("prob")).alias("p"),
        exact(F.coalesce(F.when(members > 1, F.stddev_samp("prob")), F.lit(0.0))).alias("sd"),
        members.alias("members"),
        F.min("prob").alias("p_min"),
        F.max("prob").alias("p_max"),
        F.sum(F.when(F.col("prob").isNotNull(), F.col("n_obs"))).alias("n_obs"),
    ]


def ensemble_summary(members: DataFrame) -> DataFrame:
    """Mean p, sample standard deviation (0 if one member), number, least and largest of each cell's members, and their observations."""
    return members.groupBy(CELL).agg(*summary_columns())


def quantiles_of(lo: float = 0.05, hi: float = 0.95) -> Column:
    return F.percentile("prob", F.array(F.lit(lo), F.lit(0.5), F.lit(hi)))


def ensemble_interval(members: DataFrame, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Quantiles lo, 0.5 and hi of each cell's members, linearly interpolated."""
    return members.groupBy(CELL).agg(quantiles_of(lo, hi).alias("q")).select(*CELL, F.col("q")[0].alias("lo"), F.col("q")[1].alias("mid"), F.col("q")[2].alias("hi"))


def entropy_split(members: DataFrame) -> DataFrame:
    """Total entropy H(mean p), aleatoric mean H(p_i), and epistemic, the rest."""
    both = members.groupBy(CELL).agg(exact(F.avg("prob")).alias("p"), F.avg(entropy(F.col("prob"))).alias("aleatoric"))
    return both.withColumn("total", entropy(F.col("p"))).select(*CELL, "total", "aleatoric", (F.col("total") - F.col("aleatoric")).alias("epistemic"))


def exceedance(obs: DataFrame, levels: tuple[float, ...] = (60.0, 90.0, 120.0)) -> DataFrame:
    """Share of each cell's observations at or above each level, with its binomial standard error.

    All levels are counted in one aggregate and unfolded after it, so observations aren't multiplied.
    """
    counts = [F.count(F.when(F.col("value") >= x, 1)).alias(f"n{i}") for i, x in enumerate(levels)]
    cells = obs.groupBy("zone_id", F.to_date("ts").alias("valid_date")).agg(F.count("*").alias("n"), *counts)
    levels_of = F.array(*(F.struct(F.lit(float(x)).alias("level"), F.col(f"n{i}").alias("above")) for i, x in enumerate(levels)))
    share = F.col("above") / F.col("n")
    return cells.select(*CELL, "n", F.explode(levels_of).alias("x")).select(*CELL, "x.level", "n", "x.above").select(*CELL, "level", "n", share.alias("share"), F.sqrt(share * (1 - share) / F.col("n")).alias("se"))


def tile_sums(pixels: DataFrame, **terms: Callable[[Column, Column], Column]) -> DataFrame:
    """tile_id, n and the sum of each term, a function of prob and wet, over a tile's pixels.

    pixels: a row for each pixel, or one for each tile with an array `pixels`, which is
    summed up in its row without a shuffle. Tiles without pixels are left out.
    """
    if "pixels" not in pixels.columns:
        return pixels.groupBy("tile_id").agg(F.count("*").alias("n"), *(F.sum(f(F.col("prob"), F.col("wet"))).alias(name) for name, f in terms.items()))
    zero = F.struct(*(F.lit(0.0).alias(name) for name in terms))
    sums = F.aggregate("pixels", zero, lambda t, x: F.struct(*((t[name] + f(x["prob"], x["wet"]).cast("double")).alias(name) for name, f in terms.items())))
    rows = pixels.where(F.size("pixels") > 0).select("tile_id", F.size("pixels").cast("long").alias("n"), sums.alias("t"))
    return rows.select("tile_id", "n", "t.*")


def segmentation_fraction(pixels: DataFrame, zones: int = 25, by_zone: bool = False) -> DataFrame:
    """Fraction of water with its standard error, of each tile or, by tile_id modulo `zones`, of each zone."""
    rows = tile_sums(pixels, p=lambda p, _: p, v=lambda p, _: p * (1 - p))
    if by_zone:
        rows = rows.groupBy((F.col("tile_id") % zones).cast("int").alias("zone_id")).agg(*(F.sum(c).alias(c) for c in ("n", "p", "v")))
    return rows.select("zone_id" if by_zone else "tile_id", "n", (F.col("p") / F.col("n")).alias("fraction"), (F.sqrt("v") / F.col("n")).alias("se"))


def segmentation_ambiguity(pixels: DataFrame, band: float = 0.1) -> DataFrame:
    """Share of each tile's pixels within `band` of 0.5, and their mean entropy."""
    rows = tile_sums(pixels, near=lambda p, _: F.when(F.abs(p - 0.5) < band, 1.0).otherwise(0.0), entropy=lambda p, _: entropy(p))
    return rows.select("tile_id", (F.col("near") / F.col("n")).alias("ambiguous"), (F.col("entropy") / F.col("n")).alias("mean_entropy"))


def variance_of(sd: Column, floor: float = 1e-6) -> Column:
    """Null without sd: greatest() skips nulls, but a missing source has no variance."""
    return F.when(sd.isNotNull(), F.greatest(sd * sd, F.lit(floor)))


def disagreement_of(p1: Column, v1: Column, p2: Column, v2: Column) -> Column:
    """Distance of two sources in standard deviations."""
    return F.abs(p1 - p2) / F.sqrt(v1 + v2)


def fuse_sources(summary: DataFrame, zone_fraction: DataFrame, floor: float = 1e-6) -> DataFrame:
    """Inverse-variance mean of forecast and zone segmentation, its deviation and how far the sources disagree.

    A cell or zone with one source keeps it and is flagged. Tiles have no date, so a zone's tiles count for every day.
    """
    seg = zone_fraction.select("zone_id", exact(F.col("fraction")).alias("p2"), exact(F.col("se")).alias("se2"))
    both = summary.select(*CELL, F.col("p").alias("p1"), F.col("sd").alias("sd1")).join(seg, "zone_id", "full_outer")
    v1, v2 = (variance_of(F.col(s), floor) for s in ("sd1", "se2"))
    w = 1 / v1 + 1 / v2
    return both.select(
        *CELL,
        F.coalesce((F.col("p1") / v1 + F.col("p2") / v2) / w, "p1", "p2").alias("fused"),
        F.coalesce(F.sqrt(1 / w), F.sqrt(v1), F.sqrt(v2)).alias("fused_sd"),
        disagreement_of(F.col("p1"), v1, F.col("p2"), v2).alias("disagreement"),
        F.when(F.col("p1").isNull(), "segmentation").when(F.col("p2").isNull(), "forecast").otherwise("both").alias("sources"),
    )
