"""How reliable forecasts are: scores, calibration, coverage and recalibration."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import exact, ratio
from .uncertainty import tile_sums

CELL = ["zone_id", "valid_date"]
CLIP = 1e-6


def with_outcome(summary: DataFrame, outcome: DataFrame) -> DataFrame:
    return summary.select(*CELL, "p").join(outcome.select(*CELL, F.col("flooded").alias("y")), CELL)


def score_probabilities(summary: DataFrame, outcome: DataFrame, zone: DataFrame) -> DataFrame:
    """Brier score and log loss by district and overall (district ALL), of p and of the hard forecast p >= 0.5."""
    cells = with_outcome(summary, outcome).join(zone.select("zone_id", "district_name"), "zone_id")
    hard = F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)

    def measures(p, name):
        q = F.least(F.greatest(p, F.lit(CLIP)), F.lit(1 - CLIP))
        loss = -F.when(F.col("y") == 1, F.ln(q)).otherwise(F.ln(1 - q))
        return [F.avg((p - F.col("y")) * (p - F.col("y"))).alias(f"{name}brier"), F.avg(loss).alias(f"{name}log_loss")]

    rolled = cells.rollup("district_name").agg(F.grouping("district_name").alias("g"), F.count("*").alias("n"), *measures(F.col("p"), ""), *measures(hard, "hard_"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("district_name")).alias("district"), "n", "brier", "log_loss", "hard_brier", "hard_log_loss")


def bin_of(p, bins: int):
    """The last bin is closed."""
    return F.least(F.floor(p * bins).cast("int"), F.lit(bins - 1))


def reliability_table(summary: DataFrame, outcome: DataFrame, bins: int = 10) -> DataFrame:
    """Number, mean p and observed rate of each bin of p."""
    cells = with_outcome(summary, outcome).withColumn("bin", bin_of(F.col("p"), bins))
    return cells.groupBy("bin").agg(F.count("*").alias("n"), exact(F.avg("p")).alias("mean_p"), exact(F.avg("y")).alias("rate"))


def calibration_error(table: DataFrame) -> DataFrame:
    """Expected and maximum gap between mean p and observed rate."""
    gap = F.abs(F.col("mean_p") - F.col("rate"))
    return table.agg(ratio(F.sum(F.col("n") * gap), F.sum("n")).alias("ece"), F.max(gap).alias("mce"))


def brier_decomposition(table: DataFrame) -> DataFrame:
    """Reliability, resolution and uncertainty of the binned forecast."""
    n = F.sum("n")
    total = table.agg(n.alias("all_n"), (F.sum(F.col("n") * F.col("rate")) / n).alias("base"))
    gap, lift = F.col("mean_p") - F.col("rate"), F.col("rate") - F.col("base")
    # `total` is one row.
    return table.join(F.broadcast(total)).agg(
        (F.sum(F.col("n") * gap * gap) / F.max("all_n")).alias("reliability"),
        (F.sum(F.col("n") * lift * lift) / F.max("all_n")).alias("resolution"),
        (F.max("base") * (1 - F.max("base"))).alias("uncertainty"),
    )


def interval_coverage(outcome: DataFrame, cut: str, lo: float = 0.05, hi: float = 0.95) -> DataFrame:
    """Per zone: interval of the peaks before the cut, share of later peaks inside, width; all zones as zone_id -1."""
    early, late = F.col("valid_date") < F.lit(cut).cast("date"), F.col("valid_date") >= F.lit(cut).cast("date")
    q = outcome.where(early).groupBy("zone_id").agg(F.percentile("peak", F.array(F.lit(lo), F.lit(hi))).alias("q"))
    q = q.select("zone_id", exact(F.col("q")[0]).alias("lo"), exact(F.col("q")[1]).alias("hi"))
    cells = outcome.where(late).join(q, "zone_id").withColumn("inside", F.col("peak").between(F.col("lo"), F.col("hi")).cast("double")).withColumn("width", F.col("hi") - F.col("lo"))
    rolled = cells.rollup("zone_id").agg(F.grouping("zone_id").alias("g"), F.count("*").alias("n"), F.avg("inside").alias("coverage"), F.avg("width").alias("mean_width"))
    return rolled.select(F.when(F.col("g") == 1, -1).otherwise(F.col("zone_id")).alias("zone_id"), "n", "coverage", "mean_width")


def crps_ensemble(members: DataFrame, outcome: DataFrame) -> DataFrame:
    """Continuous ranked probability score of each cell from the members' ranks; no pair of members is formed."""
    w, size = Window.partitionBy(*CELL).orderBy("prob", "member"), Window.partitionBy(*CELL)
    ranked = members.join(outcome.select(*CELL, F.col("flooded").alias("y")), CELL).withColumn("i", F.row_number().over(w)).withColumn("m", F.count("*").over(size))
    spread = F.sum((2 * F.col("i") - F.col("m") - 1) * F.col("prob") / (F.col("m") * F.col("m")))
    return ranked.groupBy(CELL).agg((F.avg(F.abs(F.col("prob") - F.col("y"))) - spread).alias("crps"))


def segmentation_scores(pixels: DataFrame) -> DataFrame:
    """Counts at 0.5, IoU, Dice, precision and recall of each tile and of all (tile_id -1); null where a denominator is 0."""
    cell = lambda hit, wet: lambda p, w: (((p >= 0.5) == F.lit(hit)) & ((w == 1) == F.lit(wet))).cast("long")
    names = {"tp": cell(True, True), "fp": cell(True, False), "fn": cell(False, True), "tn": cell(False, False)}
    tiles = tile_sums(pixels, **names).select("tile_id", *(F.col(c).cast("long").alias(c) for c in names))
    # One row, if there are tiles.
    total = tiles.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names)).where("n > 0").select(F.lit(-1).cast("long").alias("tile_id"), *names)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return tiles.unionByName(total).select(
        "tile_id", "tp", "fp", "fn", "tn",
        ratio(tp, tp + fp + fn).alias("iou"), ratio(2 * tp, 2 * tp + fp + fn).alias("dice"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
    )


def recalibrate(summary: DataFrame, outcome: DataFrame, cut: str, method: str = "histogram", bins: int = 10) -> DataFrame:
    """Cells from the cut on with p replaced by what cells of that p before it showed; where there were none p stays."""
    day = F.lit(cut).cast("date")
    early, late = summary.where(F.col("valid_date") < day), summary.where(F.col("valid_date") >= day)
    if method == "histogram":
        table = reliability_table(early, outcome, bins).select("bin", "rate")
        # The table has `bins` rows at most.
        binned = late.select(*CELL, "p", bin_of(F.col("p"), bins).alias("bin")).join(F.broadcast(table), "bin", "left")
        return binned.select(*CELL, "p", F.coalesce("rate", "p").alias("recalibrated"))
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import IsotonicRegression

    as_vector = VectorAssembler(inputCols=["p"], outputCol="features")
    # Cells of one p count as one weighted point.
    points = with_outcome(early, outcome).groupBy("p").agg(F.avg("y").alias("y"), F.count("*").cast("double").alias("weight"))
    model = IsotonicRegression(labelCol="y", predictionCol="recalibrated", weightCol="weight").fit(as_vector.transform(points))
    return model.transform(as_vector.transform(late.select(*CELL, "p"))).select(*CELL, "p", "recalibrated")


#: Places of p that isotonic blocks tell apart: 10,001 values.
STEPS = 10_000


def merged_blocks(blocks: Iterator[tuple[float, float, float]]) -> list[tuple[float, float, float]]:
    """(start, sum of y, weight) of the blocks of pool-adjacent-violators, of points or blocks in order.

    A block that doesn't lie above the one before joins it, so the blocks of a part can
    be merged with those of the next as points are.
    """
    stack: list[tuple[float, float, float]] = []
    for start, total, weight in blocks:
        while stack and stack[-1][1] * weight >= total * stack[-1][2]:
            first, t, w = stack.pop()
            start, total, weight = first, t + total, w + weight
        stack.append((start, total, weight))
    return stack


def isotonic_blocks(points: DataFrame) -> DataFrame:
    """s (first of the block), total, weight of the blocks of an isotonic fit; points: s, total, weight, each s once.

    Parts of the range of s are pooled by themselves, then their blocks together: what meets in the last
    task are blocks, 10,001 at most.
    """

    def pooled(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = (row for part in parts for row in zip(part["s"].tolist(), part["total"].tolist(), part["weight"].tolist(), strict=True))
        yield pd.DataFrame(merged_blocks(rows), columns=["s", "total", "weight"]).astype({"s": "int32", "total": "float64", "weight": "float64"})

    kind = "s int, total double, weight double"
    parts = points.select("s", F.col("total").cast("double"), F.col("weight").cast("double")).repartitionByRange("s").sortWithinPartitions("s").mapInPandas(pooled, kind)
    return parts.coalesce(1).sortWithinPartitions("s").mapInPandas(pooled, kind)


def recalibrate_isotonic(summary: DataFrame, outcome: DataFrame, cut: str) -> DataFrame:
    """Cells from the cut on with p replaced by an isotonic fit of what cells before it showed, p at four places.

    Between the values of the fit its next lower one holds, below the least the least; without any early cell p stays.
    The fit is a table of 10,001 rows at most, which is broadcast.
    """
    day = F.lit(cut).cast("date")
    step = F.round(F.round(F.col("p") + 1e-9, 4) * STEPS).cast("int").alias("s")
    early = with_outcome(summary, outcome).where(F.col("valid_date") < day)
    blocks = isotonic_blocks(early.groupBy(step).agg(F.sum("y").alias("total"), F.count("*").alias("weight")))
    by_s = Window.orderBy("s")
    spans = blocks.select(
        F.when(F.row_number().over(by_s) == 1, 0).otherwise(F.col("s")).alias("lo"), F.coalesce(F.lead("s").over(by_s) - 1, F.lit(STEPS)).alias("hi"), F.round(F.col("total") / F.col("weight"), 9).alias("fit")
    )
    table = spans.select(F.explode(F.sequence("lo", "hi")).alias("s"), "fit")
    late = summary.where(F.col("valid_date") >= day).select(*CELL, "p", step)
    return late.join(F.broadcast(table), "s", "left").select(*CELL, "p", F.coalesce("fit", "p").alias("recalibrated"))
