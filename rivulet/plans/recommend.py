"""The entry points: evaluate policies, recommend actions, follow a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decisions, gating, recommendation, reliability, uncertainty
from ..sources.tables import CUT, Tables, is_probability


class Plan:
    """Everything that the entry points share, each part declared once. Nothing runs until a result is asked for, unless parts are kept."""

    def __init__(self, spark: SparkSession, folder: str, keep: bool = False):
        """keep: reads the events once, for plans that use them many times."""
        t = self.tables = Tables(spark, folder)
        if keep:
            t.read_once()
        self.cell = uncertainty.ensemble_summary(t.forecast_member)
        self.interval = uncertainty.ensemble_interval(t.forecast_member)
        self.features = uncertainty.features_of_days(t.daily_means)

    @property
    def fused(self) -> DataFrame:
        return uncertainty.fuse_sources(self.cell, uncertainty.segmentation_fraction(self.tables.tile, by_zone=True))

    @property
    def policies(self) -> DataFrame:
        named = lambda rows, name: rows.select(F.lit(name).alias("policy"), "zone_id", "valid_date", "action")
        actions = self.tables.action_cost
        return named(decisions.decide_uncertainty_aware(self.cell, actions), "aware").unionByName(named(decisions.decide_deterministic(self.cell, actions), "deterministic"))

    @property
    def late_policies(self) -> DataFrame:
        """Both choices on the cells from the cut on, and both on recalibrated p: what of a policy's gain is the forecast's bias."""
        actions, t = self.tables.action_cost, self.tables
        fixed = reliability.recalibrate(self.cell, t.outcome, CUT)
        late, better = fixed.select("zone_id", "valid_date", "p"), fixed.select("zone_id", "valid_date", F.col("recalibrated").alias("p"))
        chosen = {
            "aware": decisions.decide_uncertainty_aware(late, actions),
            "deterministic": decisions.decide_deterministic(late, actions),
            "aware_recalibrated": decisions.decide_uncertainty_aware(better, actions),
            "deterministic_recalibrated": decisions.decide_deterministic(better, actions),
        }
        return reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("policy"), "zone_id", "valid_date", "action") for name, rows in chosen.items()])

    @property
    def reliability(self) -> DataFrame:
        return reliability.reliability_table(self.cell, self.tables.outcome)

    @property
    def drawn(self) -> DataFrame:
        return decisions.monte_carlo_draws(self.cell, self.tables.exposure, self.tables.zone)

    @property
    def stability(self) -> DataFrame:
        return decisions.decision_stability(self.tables.forecast_member, self.cell, self.tables.action_cost)

    @property
    def gated(self) -> DataFrame:
        return gating.confidence_gate(self.cell, self.stability)

    @property
    def conformal(self) -> DataFrame:
        return gating.conformal_set(self.cell, self.tables.outcome, CUT)

    @property
    def limits(self) -> DataFrame:
        return recommendation.limitations(self.cell, self.fused, self.reliability, self.tables.removed_members)

    def parts(self) -> dict[str, DataFrame]:
        t, gated, limits = self.tables, self.gated, self.limits
        return {
            "gated": gated,
            "situation": recommendation.situation(self.cell, t.exposure),
            "rationale": recommendation.rationale(self.features),
            "confidence": recommendation.confidence(gated, self.interval),
            "alternatives": recommendation.alternatives(self.cell, t.action_cost),
            "limitations": limits,
            "needs_human": recommendation.needs_human(gated, limits, self.conformal),
            "context": recommendation.add_context(self.cell, t.zone, t.exposure, t.resource),
        }


def recommend(spark: SparkSession, folder: str) -> DataFrame:
    """One recommendation for each zone and day."""
    plan = Plan(spark, folder, keep=True)
    t = plan.tables
    members = t.raw_members.withColumn("prob", F.when(is_probability(), F.col("prob")))
    segmented = uncertainty.segmentation_fraction(t.tile, by_zone=True).select("zone_id", "fraction", "se")
    by_zone = recommendation.zone_context(t.zone, t.exposure, t.resource).join(segmented, "zone_id", "full_outer")
    quantile = gating.conformal_quantile(plan.cell, t.outcome, CUT)
    return recommendation.recommendation_by_cell(members, plan.features, t.action_cost, by_zone, plan.reliability, quantile, CUT)


def evaluate(spark: SparkSession, folder: str) -> DataFrame:
    """The uncertainty-aware policy against the deterministic one, by date and overall."""
    plan = Plan(spark, folder)
    return decisions.policy_comparison(plan.policies, plan.tables.outcome, plan.tables.action_cost)
