"""Analysis of a communication trial."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio


def exact_median(rows: DataFrame, key: str, value: str, accuracy: int = 100_000) -> DataFrame:
    """key, median of each group, linearly interpolated, for groups of any size.

    Approximate quantiles, whose ranks are off by n / accuracy at most, enclose the median closely;
    only the rows between them are ordered, about 8 / accuracy of all.
    """
    rows = rows.where(F.col(value).isNotNull()).select(key, F.col(value).alias("_v"))
    near = F.percentile_approx("_v", F.array(F.lit(0.5 - 4 / accuracy), F.lit(0.5 + 4 / accuracy)), F.lit(accuracy))
    bounds = rows.groupBy(key).agg(F.count("*").alias("_n"), near.alias("_q")).select(key, "_n", F.col("_q")[0].alias("_lo"), F.col("_q")[1].alias("_hi"))
    held = rows.join(bounds, key)
    below = held.groupBy(key).agg(F.count(F.when(F.col("_v") < F.col("_lo"), 1)).alias("_below"))
    inside = held.where("_v between _lo and _hi").join(below, key)
    rank = F.col("_below") + F.row_number().over(Window.partitionBy(key).orderBy("_v")) - 1
    middle = (F.col("_n") - 1) / 2
    return inside.withColumn("_rank", rank).where((F.col("_rank") >= F.floor(middle)) & (F.col("_rank") <= F.ceil(middle))).groupBy(key).agg(F.avg("_v").alias("median"))


def arm_summary(trial: DataFrame) -> DataFrame:
    """Per arm: right reliance, over-reliance (accepted though wrong), under-reliance (rejected though right), median time."""
    right, accepted = F.col("ai_correct") == 1, F.col("accepted") == 1
    count = lambda x: F.count(F.when(x, 1))
    counts = trial.groupBy("arm").agg(
        F.count("*").alias("trials"),
        ratio(count(right == accepted), F.count("*")).alias("right_reliance"),
        ratio(count(~right & accepted), count(~right)).alias("over_reliance"),
        ratio(count(right & ~accepted), count(right)).alias("under_reliance"),
    )
    medians = exact_median(trial, "arm", "decision_seconds").withColumnRenamed("median", "median_seconds")
    return counts.join(medians, "arm", "left")


def arm_contrast(trial: DataFrame, first: str = "uncertainty", second: str = "point", z: float = 1.96) -> DataFrame:
    """Difference of the arms' right reliance with Welch's standard error and interval.

    On participants' means, since trials of one person aren't independent.
    """
    right = (F.col("ai_correct") == F.col("accepted")).cast("double")
    people = trial.groupBy("arm", "participant_id").agg(F.avg(right).alias("mean"))
    of = lambda f, arm: f(F.when(F.col("arm") == arm, F.col("mean")))
    sums = people.agg(*(of(f, arm).alias(f"{name}_{k}") for k, arm in (("a", first), ("b", second)) for name, f in (("mean", F.avg), ("var", F.var_samp), ("n", F.count))))
    se = F.sqrt(F.col("var_a") / F.col("n_a") + F.col("var_b") / F.col("n_b"))
    gap = F.col("mean_a") - F.col("mean_b")
    return sums.select("n_a", "n_b", gap.alias("difference"), se.alias("se"), (gap - z * se).alias("lo"), (gap + z * se).alias("hi"))
