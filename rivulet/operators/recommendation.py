"""The recommendation record: what happens, why, how sure, what else, what limits it, when a person must check."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numbers import exact
from .decisions import best_at, next_best, with_actions, zone_population
from .gating import conformal_label, gate_of
from .reliability import bin_of
from .uncertainty import disagreement_of, quantiles_of, summary_columns, variance_of

CELL = ["zone_id", "valid_date"]


def situation(summary: DataFrame, exposure: DataFrame) -> DataFrame:
    """p, expected people affected and the change of p since the day before (null if that day is missing)."""
    w = Window.partitionBy("zone_id").orderBy(F.datediff("valid_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-1, -1)
    rows = summary.withColumn("before", F.max("p").over(w)).join(zone_population(exposure), "zone_id", "left")
    return rows.select(*CELL, "p", (F.col("p") * F.coalesce("population", F.lit(0.0))).alias("expected_affected"), (F.col("p") - F.col("before")).alias("change"))


def rationale(features: DataFrame, k: int = 2) -> DataFrame:
    """The k sensors of each cell that lie furthest from their mean of the seven days before; ties by name."""
    distance = F.round(F.abs(F.col("mean_value") - F.col("week_mean")), 6)
    rows = features.where("week_mean is not null").withColumn("distance", distance)
    w = Window.partitionBy(*CELL).orderBy(F.desc("distance"), "sensor")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(*CELL, "rank", "sensor", "mean_value", "week_mean", "distance")


def confidence(gated: DataFrame, interval: DataFrame) -> DataFrame:
    """Deviation, interval, gate and a label from the gate."""
    return gated.select(*CELL, "sd", "gate").join(interval.select(*CELL, "lo", "hi"), CELL).withColumn("label", label_of(F.col("gate")))


def label_of(gate: Column) -> Column:
    return F.when(gate == "act", "high").when(gate == "verify", "medium").otherwise("low")


def alternatives(summary: DataFrame, actions: DataFrame, k: int = 2) -> DataFrame:
    """The k next actions of each cell with their extra loss over the best."""
    rows = with_actions(summary.select(*CELL, "p"), actions)
    return rows.select(*CELL, F.explode(next_best(F.col("p"), k)).alias("x")).select(*CELL, "x.*")


# The flags in the order in which they are listed.
FLAGS = ("few_members", "few_observations", "no_segmentation", "sources_disagree", "poorly_calibrated", "probabilities_removed")


def limitations(summary: DataFrame, fused: DataFrame, reliability: DataFrame, removed: DataFrame | None = None, all_members: int = 5, least_obs: int = 10, disagreement: float = 2.0, gap: float = 0.1, bins: int = 10) -> DataFrame:
    """Every cell with the array of its flags.

    fused may lack cells (no second source); reliability has a row for each bin at most;
    removed has the number of unusable probabilities of the cells that had any.
    """
    bad = reliability.where(F.abs(F.col("mean_p") - F.col("rate")) > gap).select(F.col("bin").alias("_bin"), F.lit(True).alias("bad_bin"))
    rows = summary.withColumn("_bin", bin_of(F.col("p"), bins)).join(F.broadcast(bad), "_bin", "left").join(fused.select(*CELL, "sources", "disagreement"), CELL, "left")
    rows = rows.withColumn("_removed", F.lit(0)) if removed is None else rows.join(removed.select(*CELL, F.col("removed").alias("_removed")), CELL, "left")
    tests = [
        F.col("members") < all_members,
        F.col("n_obs") < least_obs,
        F.coalesce(F.col("sources") != "both", F.lit(True)),
        F.col("disagreement") > disagreement,
        F.coalesce("bad_bin", F.lit(False)),
        F.coalesce(F.col("_removed") > 0, F.lit(False)),
    ]
    return rows.select(*CELL, flags_of(tests).alias("flags"))


def flags_of(tests: list[Column], names: tuple[str, ...] = FLAGS) -> Column:
    """The names of the tests that hold, in order."""
    return F.array_compact(F.array(*(F.when(t, name) for t, name in zip(tests, names, strict=True))))


def needs_human(gated: DataFrame, limits: DataFrame, conformal: DataFrame) -> DataFrame:
    """Whether a person must check a cell, and the first reason that applies; a cell without a conformal set (before the cut) passes that test."""
    rows = gated.select(*CELL, "action", "gate").join(limits, CELL, "left").join(conformal.select(*CELL, "labels"), CELL, "left")
    unclear = F.col("labels").isNotNull() & (F.col("labels") != "wet")
    reason = reason_of(F.coalesce(F.size("flags"), F.lit(0)), unclear, "evacuation without a clear conformal set")
    return rows.withColumn("reason", reason).select(*CELL, F.col("reason").isNotNull().alias("needs_human"), F.coalesce("reason", F.lit("none")).alias("reason"))


def reason_of(flags: Column, unclear: Column, told: str) -> Column:
    """Why a person must check, of rows with gate and action; null: nobody must. unclear: why an evacuation isn't sure, as told."""
    gate = F.when(F.col("gate") != "act", F.concat(F.lit("gate is "), "gate"))
    return gate.when(flags >= 2, "several limitations").when((F.col("action") == "evacuate") & unclear, told)


def zone_context(zone: DataFrame, exposure: DataFrame, resource: DataFrame) -> DataFrame:
    """Names, population, capacity and number of assets of each zone; all are summed by zone before the join."""
    people = exposure.groupBy("zone_id").agg(exact(F.sum("population")).alias("population"), F.count("*").alias("assets"))
    capacity = resource.groupBy("zone_id").agg(exact(F.sum("capacity")).alias("capacity"))
    context = zone.select("zone_id", "zone_name", "district_name").join(people, "zone_id", "left").join(capacity, "zone_id", "left")
    return context.fillna({"population": 0.0, "assets": 0, "capacity": 0.0})


def add_context(cells: DataFrame, zone: DataFrame, exposure: DataFrame, resource: DataFrame) -> DataFrame:
    """zone_context of each cell's zone; zeros for a zone that isn't listed."""
    zero = {"population": 0.0, "assets": 0, "capacity": 0.0}
    return cells.select(*CELL).join(zone_context(zone, exposure, resource), "zone_id", "left").fillna(zero)


def recommendation(parts: dict[str, DataFrame]) -> DataFrame:
    """One row a cell: action (null on abstain) and the record as a struct.

    parts: gated, situation, rationale, confidence, alternatives, limitations,
    needs_human, context - the results of the operators above.
    """
    reasons = parts["rationale"].groupBy(CELL).agg(F.sort_array(F.collect_list(F.struct("rank", "sensor", "distance"))).alias("rationale"))
    others = parts["alternatives"].groupBy(CELL).agg(F.sort_array(F.collect_list(F.struct("rank", "action", "extra_loss"))).alias("alternatives"))
    record = lambda name, *cols: parts[name].select(*CELL, F.struct(*cols).alias(name))
    rows = (
        parts["gated"].select(*CELL, F.when(F.col("gate") != "abstain", F.col("action")).alias("action"), "gate")
        .join(record("situation", "p", "expected_affected", "change"), CELL, "left")
        .join(reasons, CELL, "left")
        .join(record("confidence", "sd", "lo", "hi", "label"), CELL, "left")
        .join(others, CELL, "left")
        .join(parts["limitations"].withColumnRenamed("flags", "limitations"), CELL, "left")
        .join(record("needs_human", "needs_human", "reason"), CELL, "left")
        .join(record("context", "zone_name", "district_name", "population", "capacity", "assets"), CELL, "left")
    )
    verify = F.col("needs_human").alias("verify")
    fields = ["situation", "rationale", "confidence", "alternatives", "limitations", verify, "context"]
    return rows.select(*CELL, "action", "gate", F.struct(*fields).alias("record"))


def recommendation_by_cell(members: DataFrame, features: DataFrame, actions: DataFrame, by_zone: DataFrame, reliability: DataFrame, quantile: DataFrame, cut: str, k: int = 2, all_members: int = 5, least_obs: int = 10, disagreement: float = 2.0, gap: float = 0.1, bins: int = 10) -> DataFrame:
    """recommendation without parts to join: all that a cell's members tell is told in the row of their one aggregate.

    members: zone_id, valid_date, prob (null: removed), n_obs; a cell's members, an ensemble, are held in its row.
    by_zone: zone_context with fraction and se of the segmentation; reliability and quantile: a row for each bin, and one.
    """
    cells = members.groupBy(CELL).agg(*summary_columns(), quantiles_of().alias("_q"), F.collect_list("prob").alias("_probs"), F.count(F.when(F.col("prob").isNull(), 1)).alias("_removed"))
    cells = with_actions(cells.where("members > 0"), actions).withColumn("_best", best_at(F.col("p"))).withColumn("action", F.col("_best.action"))
    agreed = F.filter("_probs", lambda x: best_at(x)["action"] == F.col("action"))
    cells = cells.withColumn("gate", gate_of(F.round(F.size(agreed) / F.size("_probs"), 9), F.col("sd"), F.col("members"))).withColumn("alternatives", next_best(F.col("p"), k))
    day = Window.partitionBy("zone_id").orderBy(F.datediff("valid_date", F.lit("1970-01-01").cast("date"))).rangeBetween(-1, -1)
    bad = reliability.where(F.abs(F.col("mean_p") - F.col("rate")) > gap).select(F.col("bin").alias("_bin"), F.lit(True).alias("_bad"))
    reasons = rationale(features, k).groupBy(CELL).agg(F.sort_array(F.collect_list(F.struct("rank", "sensor", "distance"))).alias("rationale"))
    rows = cells.drop("_probs", "_actions", "_best").withColumn("_before", F.max("p").over(day)).withColumn("_bin", bin_of(F.col("p"), bins))
    rows = rows.join(by_zone, "zone_id", "left").join(F.broadcast(bad), "_bin", "left").join(F.broadcast(quantile)).join(reasons, CELL, "left")
    p, p2, v2 = F.col("p"), exact(F.col("fraction")), variance_of(exact(F.col("se")))
    tests = [
        F.col("members") < all_members, F.col("n_obs") < least_obs, p2.isNull(), disagreement_of(p, variance_of(F.col("sd")), p2, v2) > disagreement,
        F.coalesce("_bad", F.lit(False)), F.col("_removed") > 0,
    ]
    labels = F.when(F.col("valid_date") >= F.lit(cut).cast("date"), conformal_label(p, F.col("q")))
    rows = rows.withColumn("limitations", flags_of(tests)).withColumn("_labels", labels)
    rows = rows.withColumn("_reason", reason_of(F.size("limitations"), F.col("_labels").isNotNull() & (F.col("_labels") != "wet"), "evacuation without a clear conformal set"))
    known = lambda c, zero: F.coalesce(c, F.lit(zero)).alias(c)
    record = F.struct(
        F.struct("p", (p * F.coalesce("population", F.lit(0.0))).alias("expected_affected"), (p - F.col("_before")).alias("change")).alias("situation"),
        "rationale",
        F.struct("sd", F.col("_q")[0].alias("lo"), F.col("_q")[2].alias("hi"), label_of(F.col("gate")).alias("label")).alias("confidence"),
        "alternatives",
        "limitations",
        F.struct(F.col("_reason").isNotNull().alias("needs_human"), F.coalesce("_reason", F.lit("none")).alias("reason")).alias("verify"),
        F.struct("zone_name", "district_name", known("population", 0.0), known("capacity", 0.0), known("assets", 0)).alias("context"),
    )
    return rows.select(*CELL, F.when(F.col("gate") != "abstain", F.col("action")).alias("action"), "gate", record.alias("record"))


def as_json(recommendations: DataFrame) -> DataFrame:
    """The record as a JSON string."""
    return recommendations.withColumn("record", F.to_json("record"))
