"""Holding back where confidence is too low."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import ratio
from .reliability import with_outcome

CELL = ["zone_id", "valid_date"]


def gate_of(stability: Column, sd: Column, members: Column, least_members: int = 3, abstain_below: float = 0.2, act_from: float = 0.6, act_sd: float = 0.15) -> Column:
    """act, verify or abstain."""
    return F.when((stability < abstain_below) | (members < least_members), "abstain").when((stability >= act_from) & (sd <= act_sd), "act").otherwise("verify")


def confidence_gate(summary: DataFrame, stability: DataFrame, least_members: int = 3, abstain_below: float = 0.2, act_from: float = 0.6, act_sd: float = 0.15) -> DataFrame:
    """act, verify or abstain for each cell, by stability, spread and number of members."""
    gate = gate_of(F.col("stability"), F.col("sd"), F.col("members"), least_members, abstain_below, act_from, act_sd)
    return summary.select(*CELL, "p", "sd", "members").join(stability.select(*CELL, "action", "stability"), CELL).withColumn("gate", gate)


def conformal_quantile(summary: DataFrame, outcome: DataFrame, cut: str, alpha: float = 0.1) -> DataFrame:
    """One row q, in steps of 1e-4, of the scores of the cells before the cut; null, which leaves both labels, if there are too few.

    Scores are counted by their four decimals (at most 10,001 rows); a running sum over
    those finds the quantile.
    """
    score = F.round(F.when(F.col("y") == 1, 1 - F.col("p")).otherwise(F.col("p")) + 1e-9, 4)
    scores = with_outcome(summary, outcome).where(F.col("valid_date") < F.lit(cut).cast("date")).groupBy(F.round(score * 10000).cast("int").alias("s")).agg(F.count("*").alias("n"))
    running = scores.select("s", F.sum("n").over(Window.orderBy("s")).alias("up_to"), F.sum("n").over(Window.partitionBy()).alias("total"))
    return running.where(F.col("up_to") >= F.ceil((F.col("total") + 1) * (1 - alpha) - 1e-9)).agg(F.min("s").alias("q"))


def conformal_label(p: Column, q: Column) -> Column:
    """wet, dry, both or none."""
    fits = lambda x: q.isNull() | (F.round(F.round(x + 1e-9, 4) * 10000).cast("int") <= q)
    wet, dry = fits(1 - p), fits(p)
    return F.when(wet & dry, "both").when(wet, "wet").when(dry, "dry").otherwise("none")


def conformal_set(summary: DataFrame, outcome: DataFrame, cut: str, alpha: float = 0.1) -> DataFrame:
    """Split conformal: which labels each cell from the cut on can't be denied, at error rate alpha."""
    late = summary.where(F.col("valid_date") >= F.lit(cut).cast("date")).join(F.broadcast(conformal_quantile(summary, outcome, cut, alpha)))
    return late.select(*CELL, "p", (F.col("q") / 10000.0).alias("qhat"), conformal_label(F.col("p"), F.col("q")).alias("labels"))


def conformal_coverage(conformal: DataFrame, outcome: DataFrame) -> DataFrame:
    """For each label set and all of them (ALL): cells, how many flooded, and the share whose outcome the set holds.

    The promised coverage is that of all cells together; a set by itself may mislead.
    """
    wet = F.col("y") == 1
    held = (F.col("labels") == "both") | (F.col("labels") == F.when(wet, "wet").otherwise("dry"))
    rows = conformal.join(outcome.select(*CELL, F.col("flooded").alias("y")), CELL)
    rolled = rows.rollup("labels").agg(F.grouping("labels").alias("g"), F.count("*").alias("cells"), F.sum("y").cast("long").alias("flooded"), F.avg(held.cast("double")).alias("coverage"))
    return rolled.select(F.when(F.col("g") == 1, "ALL").otherwise(F.col("labels")).alias("labels"), "cells", "flooded", "coverage")


def risk_coverage_curve(summary: DataFrame, outcome: DataFrame) -> DataFrame:
    """Coverage and error of p >= 0.5 when only cells whose confidence bin is at least b are kept; at most 101 bins are ordered."""
    wrong = ((F.col("p") >= 0.5) != (F.col("y") == 1)).cast("long")
    bins = with_outcome(summary, outcome).groupBy(F.floor(F.abs(F.col("p") - 0.5) * 200).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.sum(wrong).alias("wrong"))
    down, everything = Window.orderBy(F.desc("bin")), Window.partitionBy()
    rows = bins.select("bin", F.sum("n").over(down).alias("kept"), F.sum("wrong").over(down).alias("wrong"), F.sum("n").over(everything).alias("total"))
    return rows.select("bin", (F.col("kept") / F.col("total")).alias("coverage"), (F.col("wrong") / F.col("kept")).alias("risk"))


def pick_threshold(curve: DataFrame, target: float = 0.2) -> DataFrame:
    """The lowest bin whose risk is at most the target; null: always abstain."""
    return curve.agg(F.min(F.when(F.col("risk") <= target, F.col("bin"))).alias("bin"))


def abstention_audit(gated: DataFrame, outcome: DataFrame, zone: DataFrame) -> DataFrame:
    """Cells, errors of p >= 0.5 and error rate by district and gate and all margins (ALL)."""
    y = outcome.select(*CELL, F.col("flooded").alias("y"))
    rows = gated.join(y, CELL).join(zone.select("zone_id", "district_name"), "zone_id").withColumn("wrong", ((F.col("p") >= 0.5) != (F.col("y") == 1)).cast("long"))
    cubed = rows.cube("district_name", "gate").agg(F.grouping("district_name").alias("g1"), F.grouping("gate").alias("g2"), F.count("*").alias("cells"), F.sum("wrong").alias("errors"))
    return cubed.select(
        F.when(F.col("g1") == 1, "ALL").otherwise(F.col("district_name")).alias("district"), F.when(F.col("g2") == 1, "ALL").otherwise(F.col("gate")).alias("gate"),
        "cells", "errors", ratio(F.col("errors"), F.col("cells")).alias("error_rate"),
    )
