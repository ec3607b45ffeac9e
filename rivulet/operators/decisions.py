"""Decisions under uncertainty and the propagation of uncertainty to the city."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import exact, poisson_one, uniform

CELL = ["zone_id", "valid_date"]


def expected_loss(cells: DataFrame, actions: DataFrame) -> DataFrame:
    """Expected loss of every action in every row of cells (with a column p). Actions are a few fixed rows, so they are broadcast."""
    p = F.col("p")
    loss = F.col("fixed_cost") + p * F.col("loss_if_flood") + (1 - p) * F.col("loss_if_dry")
    return cells.join(F.broadcast(actions)).withColumn("loss", F.round(loss, 6)).drop("fixed_cost", "loss_if_flood", "loss_if_dry")


def with_actions(rows: DataFrame, actions: DataFrame) -> DataFrame:
    """rows with all actions as an array `_actions`; none, if there are no actions.

    The actions are a few fixed rows, so one row of them is broadcast, and what is chosen from them is
    chosen in each row without a shuffle.
    """
    few = actions.agg(F.collect_list(F.struct("action", "fixed_cost", "loss_if_flood", "loss_if_dry")).alias("_actions"))
    return rows.join(F.broadcast(few.where(F.size("_actions") > 0)))


def losses_at(p: Column) -> Column:
    """Expected loss and name of every action of `_actions` at probability p."""
    loss = lambda a: F.round(a["fixed_cost"] + p * a["loss_if_flood"] + (1 - p) * a["loss_if_dry"], 6)
    return F.transform("_actions", lambda a: F.struct(loss(a).alias("loss"), a["action"].alias("action")))


def best_at(p: Column) -> Column:
    """The least of losses_at; ties by the action's name."""
    return F.array_min(losses_at(p))


def next_best(p: Column, k: int) -> Column:
    """rank (from 2), action and extra loss over the best of the k actions that come next at p, in order."""
    ranked = F.sort_array(losses_at(p))
    extra = lambda x: (x["loss"] - F.element_at(ranked, 1)["loss"]).alias("extra_loss")
    return F.transform(F.slice(ranked, 2, k), lambda x, i: F.struct((i + 2).alias("rank"), x["action"].alias("action"), extra(x)))


def decide_uncertainty_aware(cells: DataFrame, actions: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The action of least expected loss of each row of cells, which has a row for each key."""
    key = key or CELL
    return with_actions(cells.select(*key, "p"), actions).select(*key, best_at(F.col("p")).alias("b")).select(*key, F.col("b.action").alias("action"), F.col("b.loss").alias("loss"))


def decide_deterministic(cells: DataFrame, actions: DataFrame) -> DataFrame:
    """The same choice with p replaced by 1 if p >= 0.5, else 0."""
    return decide_uncertainty_aware(cells.withColumn("p", F.when(F.col("p") >= 0.5, 1.0).otherwise(0.0)), actions)


def realised(policies: DataFrame, outcome: DataFrame, actions: DataFrame) -> DataFrame:
    """Realised loss, miss, false alarm and regret of each policy's action in each cell."""
    y = outcome.select(*CELL, "flooded")
    # The best action in hindsight depends on the outcome alone: two values, made from the few actions.
    best = actions.agg(F.min(F.col("fixed_cost") + F.col("loss_if_flood")).alias("best_wet"), F.min(F.col("fixed_cost") + F.col("loss_if_dry")).alias("best_dry"))
    wet = F.col("flooded") == 1
    cells = policies.join(y, CELL).join(F.broadcast(actions), "action").join(F.broadcast(best))
    cells = cells.withColumn("realised", F.col("fixed_cost") + F.when(wet, F.col("loss_if_flood")).otherwise(F.col("loss_if_dry")))
    return cells.select(
        "policy", *CELL, "realised", (F.col("realised") - F.when(wet, F.col("best_wet")).otherwise(F.col("best_dry"))).alias("regret"),
        (wet & (F.col("action") == "none")).cast("int").alias("miss"), (~wet & (F.col("action") == "evacuate")).cast("int").alias("false_alarm"),
    )


def policy_comparison(policies: DataFrame, outcome: DataFrame, actions: DataFrame) -> DataFrame:
    """Per policy and date, and per policy overall (date null): cells, realised loss, misses, false alarms, regret.

    policies: policy, zone_id, valid_date, action; any number of policies, by unionByName.
    """
    rolled = realised(policies, outcome, actions).rollup("policy", "valid_date").agg(
        F.grouping_id().alias("g"), F.count("*").alias("cells"), F.sum("realised").alias("realised_loss"), F.sum("miss").alias("misses"), F.sum("false_alarm").alias("false_alarms"), F.sum("regret").alias("regret")
    )
    return rolled.where("g < 3").drop("g")


def policy_difference_ci(policies: DataFrame, outcome: DataFrame, actions: DataFrame, first: str, second: str, draws: int = 200) -> DataFrame:
    """Bootstrap over dates of the mean loss difference first - second: mean, and its 2.5 and 97.5 % quantiles.

    A date's weight in a draw is a Poisson(1) count. Cells are summed by date before draws are unfolded.
    """
    signed = F.when(F.col("policy") == first, F.col("realised")).otherwise(-F.col("realised"))
    own = F.count(F.when(F.col("policy") == first, 1))
    dates = realised(policies.where(F.col("policy").isin(first, second)), outcome, actions).groupBy("valid_date").agg(F.sum(signed).alias("difference"), own.alias("cells"))
    drawn = dates.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1)))).withColumn("w", poisson_one(uniform("valid_date", "draw")))
    means = drawn.groupBy("draw").agg(exact(F.sum(F.col("w") * F.col("difference")) / F.nullif(F.sum(F.col("w") * F.col("cells")), F.lit(0))).alias("mean"))
    q = F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975)))
    return means.agg(F.count("mean").alias("draws"), F.avg("mean").alias("mean_difference"), q.alias("q")).select("draws", "mean_difference", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))


def zone_population(exposure: DataFrame) -> DataFrame:
    return exposure.groupBy("zone_id").agg(exact(F.sum("population")).alias("population"))


def in_districts(cells: DataFrame, exposure: DataFrame, zone: DataFrame) -> DataFrame:
    """Cells with their population (0 if none is known) and district; both tables have a row for each zone."""
    context = zone.join(zone_population(exposure), "zone_id", "left").select("zone_id", "district_name", F.coalesce("population", F.lit(0.0)).alias("population"))
    return cells.select(*CELL, "p").join(context, "zone_id")


def propagate_linear(cells: DataFrame, exposure: DataFrame, zone: DataFrame) -> DataFrame:
    """Expected people affected and deviation (independent zones) by date for zone, district (zone_id -1) and city (district ALL)."""
    p, pop = F.col("p"), F.col("population")
    rolled = in_districts(cells, exposure, zone).rollup("valid_date", "district_name", "zone_id").agg(
        F.grouping_id().alias("g"), F.sum(p * pop).alias("expected"), F.sqrt(F.sum(p * (1 - p) * pop * pop)).alias("sd")
    )
    level = F.when(F.col("g") == 0, "zone").when(F.col("g") == 1, "district").otherwise("city")
    return rolled.where("g < 7").select(
        "valid_date", level.alias("level"), F.when(F.col("g") < 3, F.col("district_name")).otherwise("ALL").alias("district"), F.when(F.col("g") == 0, F.col("zone_id")).otherwise(-1).alias("zone_id"), "expected", "sd"
    )


def monte_carlo_draws(cells: DataFrame, exposure: DataFrame, zone: DataFrame, draws: int = 200, rho: float = 0.3) -> DataFrame:
    """People affected by date, district and draw.

    A cell is hit if u < p. With probability rho a date's draw has one u for all
    zones, else each zone has its own. Draws are unfolded from the cells, never from
    observations, and summed before anything else.
    """
    drawn = in_districts(cells, exposure, zone).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    shared = uniform("valid_date", "draw", F.lit("coin")) < rho
    u = F.when(shared, uniform("valid_date", "draw", F.lit("city"))).otherwise(uniform("valid_date", "draw", "zone_id"))
    hit = F.when(u < F.col("p"), F.col("population")).otherwise(0.0)
    return drawn.groupBy("valid_date", "district_name", "draw").agg(exact(F.sum(hit)).alias("affected"))


def propagate_monte_carlo(drawn: DataFrame) -> DataFrame:
    """5, 50 and 95 % quantiles of the city's people affected, by date. rho = 0 in the draws understates the city's risk."""
    q = F.percentile("affected", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    city = drawn.groupBy("valid_date", "draw").agg(exact(F.sum("affected")).alias("affected"))
    return city.groupBy("valid_date").agg(F.count("*").alias("draws"), q.alias("q")).select("valid_date", "draws", F.col("q")[0].alias("q05"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q95"))


def capacity_shortfall(drawn: DataFrame, resource: DataFrame, zone: DataFrame) -> DataFrame:
    """Share of draws in which more people are affected than the district can take, and the mean shortfall."""
    capacity = zone.join(resource, "zone_id").groupBy("district_name").agg(exact(F.sum("capacity")).alias("capacity"))
    over = F.greatest(F.col("affected") - F.coalesce("capacity", F.lit(0.0)), F.lit(0.0))
    rows = drawn.join(capacity, "district_name", "left").withColumn("over", over)
    return rows.groupBy("valid_date", F.col("district_name").alias("district")).agg(F.avg((F.col("over") > 0).cast("double")).alias("p_shortfall"), F.avg("over").alias("mean_shortfall"))


def decision_stability(members: DataFrame, cells: DataFrame, actions: DataFrame) -> DataFrame:
    """Share of a cell's members whose own best action is the cell's."""
    own = decide_uncertainty_aware(members.select(*CELL, "member", F.col("prob").alias("p")), actions, [*CELL, "member"]).select(*CELL, F.col("action").alias("own"))
    chosen = decide_uncertainty_aware(cells, actions).select(*CELL, "action")
    return own.join(chosen, CELL).groupBy(CELL).agg(F.first("action").alias("action"), exact(F.avg((F.col("own") == F.col("action")).cast("double"))).alias("stability"))
