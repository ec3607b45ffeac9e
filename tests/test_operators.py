"""Hand-made inputs with worked answers, and properties that hold for any input."""

import datetime as dt
import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from rivulet.functions.numbers import POISSON_ONE
from rivulet.operators import communication, decisions, gating, recommendation, reliability, uncertainty
from rivulet.plans.recommend import Plan, recommend
from rivulet.sources.tables import ACTIONS, Tables

DAY = dt.date(2024, 1, 10)
MEMBER = "zone_id int, valid_date date, member string, prob double, n_obs long"
CELL = "zone_id int, valid_date date, p double"
SUMMARY = "zone_id int, valid_date date, p double, sd double, members long, n_obs long"
OUTCOME = "zone_id int, valid_date date, flooded int, peak double"


def day(n):
    return DAY + dt.timedelta(days=n)


@pytest.fixture(scope="module")
def actions(spark):
    return spark.createDataFrame(ACTIONS, "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")


@pytest.fixture(scope="module")
def members(spark):
    rows = [(1, DAY, "a", 0.2, 5), (1, DAY, "b", 0.4, 5), (1, DAY, "c", 0.9, 1), (2, DAY, "a", 0.0, 9), (3, DAY, "a", 1.0, 2), (3, DAY, "b", 1.0, 2)]
    return spark.createDataFrame(rows, MEMBER)


@pytest.fixture(scope="module")
def outcome(spark):
    return spark.createDataFrame([(1, DAY, 1, 130.0), (2, DAY, 0, 10.0), (3, DAY, 1, 140.0)], OUTCOME)


@pytest.fixture(scope="module")
def zone(spark):
    return spark.createDataFrame([(1, "Z1", 1, "D1"), (2, "Z2", 1, "D1"), (3, "Z3", 2, "D2")], "zone_id int, zone_name string, district_id int, district_name string")


def by_zone(df):
    return {r.zone_id: r for r in df.collect()}


def test_summary(members):
    got = by_zone(uncertainty.ensemble_summary(members))
    assert got[1].p == 0.5 and got[1].sd == pytest.approx(math.sqrt((0.09 + 0.01 + 0.16) / 2), abs=1e-8)
    assert (got[1].members, got[1].n_obs, got[1].p_min, got[1].p_max) == (3, 11, 0.2, 0.9)
    assert got[2].sd == 0.0 and got[2].members == 1


def test_interval(members):
    got = by_zone(uncertainty.ensemble_interval(members))
    assert (got[1].lo, got[1].mid, got[1].hi) == pytest.approx((0.22, 0.4, 0.85))


def test_entropy(members):
    got = by_zone(uncertainty.entropy_split(members))
    assert got[1].total == pytest.approx(math.log(2)) and got[2].total == 0 and got[3].aleatoric == 0
    assert all(r.epistemic >= -1e-12 for r in got.values())


def test_features(spark):
    rows = [(k, dt.datetime(2024, 1, 10 + n, 5), 1, "s", v) for k, (n, v) in enumerate([(0, 10.0), (0, 20.0), (1, 30.0), (3, 50.0), (9, 70.0)])]
    obs = spark.createDataFrame(rows, "event_id long, ts timestamp, zone_id int, sensor string, value double")
    got = {r.valid_date: r for r in uncertainty.zone_features(obs).collect()}
    assert (got[day(0)].mean_value, got[day(0)].lag_value, got[day(0)].week_mean) == (15.0, None, None)
    assert (got[day(1)].lag_value, got[day(1)].week_mean) == (15.0, 15.0)
    assert (got[day(3)].lag_value, got[day(3)].week_mean) == (None, 22.5)
    assert got[day(9)].week_mean == 50.0


def test_exceedance(spark):
    obs = spark.createDataFrame([(k, dt.datetime(2024, 1, 10), 1, "s", v) for k, v in enumerate([50.0, 60.0, 95.0, 130.0])], "event_id long, ts timestamp, zone_id int, sensor string, value double")
    got = {r.level: r for r in uncertainty.exceedance(obs).collect()}
    assert [got[x].share for x in (60.0, 90.0, 120.0)] == [0.75, 0.5, 0.25] and got[90.0].se == 0.25


def test_segmentation(spark):
    pixels = spark.createDataFrame([(26, 0, 0.5, 1), (26, 1, 0.9, 1), (26, 2, 0.1, 0), (27, 0, 0.2, 0)], "tile_id long, pixel_id int, prob double, wet int")
    tile = {r.tile_id: r for r in uncertainty.segmentation_fraction(pixels).collect()}
    assert tile[26].fraction == 0.5 and tile[26].se == pytest.approx(math.sqrt(0.25 + 0.09 + 0.09) / 3)
    assert by_zone(uncertainty.segmentation_fraction(pixels, by_zone=True))[1].n == 3
    ambiguous = {r.tile_id: r for r in uncertainty.segmentation_ambiguity(pixels).collect()}
    assert ambiguous[26].ambiguous == pytest.approx(1 / 3) and ambiguous[27].ambiguous == 0
    score = {r.tile_id: r for r in reliability.segmentation_scores(pixels).collect()}
    assert (score[26].tp, score[26].fp, score[26].fn, score[26].tn, score[26].iou) == (2, 0, 0, 1, 1.0)
    assert score[27].iou is None and score[-1].tn == 2


def test_fusion(spark):
    cells = spark.createDataFrame([(1, DAY, 0.2, 0.1, 3, 9), (2, DAY, 0.7, 0.0, 1, 9)], SUMMARY)
    seg = spark.createDataFrame([(1, 10, 0.6, 0.1), (3, 10, 0.3, 0.2)], "zone_id int, n long, fraction double, se double")
    got = by_zone(uncertainty.fuse_sources(cells, seg))
    assert got[1].fused == pytest.approx(0.4) and got[1].fused_sd == pytest.approx(0.1 / math.sqrt(2)) and got[1].disagreement == pytest.approx(0.4 / math.sqrt(0.02)) and got[1].sources == "both"
    assert (got[2].fused, got[2].sources, got[2].disagreement) == (0.7, "forecast", None)
    assert (got[3].fused, got[3].sources, got[3].fused_sd) == (0.3, "segmentation", 0.2)


def test_reliability(spark, zone):
    rows = [(1, day(k), p, y) for k, (p, y) in enumerate([(0.0, 0), (0.05, 1), (0.95, 1), (1.0, 1)])]
    cells = spark.createDataFrame([(z, d, p) for z, d, p, _ in rows], CELL)
    outcome = spark.createDataFrame([(z, d, y, 1.0) for z, d, _, y in rows], OUTCOME)
    table = reliability.reliability_table(cells, outcome)
    got = {r.bin: r for r in table.collect()}
    assert (got[0].n, got[0].mean_p, got[0].rate) == (2, 0.025, 0.5) and (got[9].n, got[9].mean_p, got[9].rate) == (2, 0.975, 1.0)
    error = reliability.calibration_error(table).first()
    assert error.ece == pytest.approx(0.25) and error.mce == pytest.approx(0.475) and error.ece <= error.mce
    parts = reliability.brier_decomposition(table).first()
    binned = (0.025**2 + 0.975**2 + 2 * 0.025**2) / 4
    assert parts.reliability - parts.resolution + parts.uncertainty == pytest.approx(binned)
    score = {r.district: r for r in reliability.score_probabilities(cells, outcome, zone).collect()}
    assert score["ALL"].brier == pytest.approx((0 + 0.95**2 + 0.05**2 + 0) / 4) and score["ALL"].hard_brier == 0.25 and score["D1"].n == 4


def test_crps_of_one_member_is_its_error(members, outcome):
    got = by_zone(reliability.crps_ensemble(members, outcome))
    assert got[2].crps == 0 and got[3].crps == 0
    pairs = sum(abs(x - y) for x in (0.2, 0.4, 0.9) for y in (0.2, 0.4, 0.9)) / (2 * 9)
    assert got[1].crps == pytest.approx((0.8 + 0.6 + 0.1) / 3 - pairs)


def test_coverage_and_recalibration(spark):
    cut = day(3).isoformat()
    outcome = spark.createDataFrame([(1, day(k), y, v) for k, (y, v) in enumerate([(1, 0.0), (1, 10.0), (0, 20.0), (1, 10.0), (0, 99.0)])], OUTCOME)
    got = by_zone(reliability.interval_coverage(outcome, cut, 0.0, 1.0))
    assert (got[1].coverage, got[1].mean_width, got[-1].n) == (0.5, 20.0, 2)
    cells = spark.createDataFrame([(1, day(k), p) for k, p in enumerate([0.31, 0.32, 0.33, 0.35, 0.95])], CELL)
    new = {r.valid_date: r.recalibrated for r in reliability.recalibrate(cells, outcome, cut).collect()}
    assert new[day(3)] == pytest.approx(2 / 3) and new[day(4)] == 0.95
    assert reliability.recalibrate(cells, outcome, cut, "isotonic").count() == 2


def test_decisions(spark, actions, outcome):
    cells = spark.createDataFrame([(1, DAY, 0.0), (2, DAY, 0.45), (3, DAY, 1.0)], CELL)
    aware, hard = by_zone(decisions.decide_uncertainty_aware(cells, actions)), by_zone(decisions.decide_deterministic(cells, actions))
    assert [aware[z].action for z in (1, 2, 3)] == ["none", "preposition", "evacuate"]
    assert [hard[z].action for z in (1, 2, 3)] == ["none", "none", "evacuate"]
    losses = {(r.zone_id, r.action): r.loss for r in decisions.expected_loss(cells, actions).collect()}
    assert all(aware[z].loss <= losses[z, a] for z, a in losses) and losses[2, "monitor"] == pytest.approx(8 + 0.45 * 75)
    policies = decisions.decide_uncertainty_aware(cells, actions).selectExpr("'x' as policy", "zone_id", "valid_date", "action")
    total = next(r for r in decisions.policy_comparison(policies, outcome, actions).collect() if r.valid_date is None)
    # Zone 1 floods unprotected (100), zone 2 is dry (20), zone 3 floods evacuated (45); the best would be 45 + 0 + 45.
    assert (total.cells, total.realised_loss, total.misses, total.false_alarms, total.regret) == (3, 165.0, 1, 0, 75.0)


def test_ties_go_by_name(spark):
    tied = spark.createDataFrame([("b", 1.0, 0.0, 0.0), ("a", 1.0, 0.0, 0.0)], "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")
    assert decisions.decide_uncertainty_aware(spark.createDataFrame([(1, DAY, 0.3)], CELL), tied).first().action == "a"


def test_actions_are_chosen_in_their_rows(spark, actions):
    cells = spark.createDataFrame([(1, DAY, 0.45), (2, DAY, None)], CELL)
    chosen = decisions.decide_uncertainty_aware(cells, actions)
    chosen.collect()
    # The only exchanges are those of the one row of actions.
    assert "hashpartitioning" not in chosen._jdf.queryExecution().executedPlan().toString()
    # Unknown p: no loss, and the action by name.
    assert (by_zone(chosen)[2].action, by_zone(chosen)[2].loss) == ("evacuate", None)
    others = recommendation.alternatives(cells.where("zone_id = 1"), actions)
    ranked = sorted((r.loss, r.action) for r in decisions.expected_loss(cells.where("zone_id = 1"), actions).collect())
    assert [(r.rank, r.action, r.extra_loss) for r in others.orderBy("rank").collect()] == [(i, a, pytest.approx(x - ranked[0][0])) for i, (x, a) in enumerate(ranked[1:3], 2)]
    assert decisions.decide_uncertainty_aware(cells, actions.limit(0)).count() == 0 and recommendation.alternatives(cells, actions.where("action = 'none'")).count() == 0


def near(a, b):
    if isinstance(a, (list, tuple)) and isinstance(b, (list, tuple)):
        return len(a) == len(b) and all(map(near, a, b))
    return a == b or isinstance(a, float) and isinstance(b, float) and a == pytest.approx(b, abs=1e-8)


def test_record_by_cell_equals_the_joined_parts(spark, sf_dir):
    plan = Plan(spark, sf_dir, keep=True)
    want = {(r.zone_id, r.valid_date): r for r in recommendation.recommendation(plan.parts()).collect()}
    found = recommend(spark, sf_dir)
    assert "events.parquet" not in found._jdf.queryExecution().optimizedPlan().toString() and "events" not in "".join(found.inputFiles())
    got = {(r.zone_id, r.valid_date): r for r in found.collect()}
    assert got.keys() == want.keys() and found.columns == ["zone_id", "valid_date", "action", "gate", "record"]
    assert [k for k in got if not near(got[k], want[k])] == []


def test_record_by_cell_with_removed_members(spark, actions, zone):
    members = spark.createDataFrame([(1, DAY, "a", 0.4, 5), (1, DAY, "b", None, 7), (2, DAY, "a", None, 3)], MEMBER)
    features = spark.createDataFrame([], "zone_id int, valid_date date, sensor string, mean_value double, week_mean double")
    empty = {"exposure": "zone_id int, asset_id long, population double", "resource": "zone_id int, resource_id long, capacity double", "fraction": "zone_id int, fraction double, se double", "bins": "bin int, n long, mean_p double, rate double"}
    of = {name: spark.createDataFrame([], kind) for name, kind in empty.items()}
    by_zone_table = recommendation.zone_context(zone, of["exposure"], of["resource"]).join(of["fraction"], "zone_id", "full_outer")
    quantile = spark.createDataFrame([(None,)], "q int")
    got = recommendation.recommendation_by_cell(members, features, actions, by_zone_table, of["bins"], quantile, DAY.isoformat()).collect()
    # A cell of removed members alone has no record; one member of one is stable, but too few.
    assert [(r.zone_id, r.gate, r.action) for r in got] == [(1, "abstain", None)]
    assert got[0].record.limitations == ["few_members", "few_observations", "no_segmentation", "probabilities_removed"] and got[0].record.rationale is None
    assert got[0].record.situation.p == 0.4 and got[0].record.verify.reason == "gate is abstain" and got[0].record.context.population == 0.0


def test_propagation(spark, zone):
    cells = spark.createDataFrame([(1, DAY, 0.5), (2, DAY, 0.5), (3, DAY, 1.0)], CELL)
    exposure = spark.createDataFrame([(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)], "zone_id int, asset_id long, population double")
    got = {(r.level, r.district, r.zone_id): r for r in decisions.propagate_linear(cells, exposure, zone).collect()}
    assert got["city", "ALL", -1].expected == 2.0 and got["city", "ALL", -1].sd == pytest.approx(math.sqrt(0.5)) and got["district", "D1", -1].expected == 1.0 and len(got) == 6
    drawn = decisions.monte_carlo_draws(cells, exposure, zone, draws=2000, rho=0.0)
    city = [r.a for r in drawn.groupBy("draw").sum("affected").withColumnRenamed("sum(affected)", "a").collect()]
    mean = sum(city) / len(city)
    assert mean == pytest.approx(2.0, abs=0.06) and sum((x - mean) ** 2 for x in city) / len(city) == pytest.approx(0.5, abs=0.06)
    resource = spark.createDataFrame([(1, 1, 1.5)], "zone_id int, resource_id long, capacity double")
    short = {r.district: r for r in decisions.capacity_shortfall(drawn, resource, zone).collect()}
    assert short["D2"].p_shortfall == 1.0 and short["D1"].p_shortfall == pytest.approx(0.25, abs=0.04)


def test_gate_needs_members(spark, actions, members):
    summary = uncertainty.ensemble_summary(members)
    stable = decisions.decision_stability(members, summary, actions)
    got = by_zone(gating.confidence_gate(summary, stable))
    # Members of zone 1 choose none, preposition, evacuate; the cell's best at 0.5 is evacuate (ties by name).
    assert got[1].stability == pytest.approx(1 / 3) and got[1].gate == "verify" and got[2].gate == "abstain"


def test_conformal_and_curve(spark):
    cut = day(4).isoformat()
    cells = spark.createDataFrame([(1, day(k), p) for k, p in enumerate([0.9, 0.8, 0.7, 0.6, 0.95, 0.5, 0.05])], CELL)
    outcome = spark.createDataFrame([(1, day(k), 1, 1.0) for k in range(7)], OUTCOME)
    # Scores 0.1, 0.2, 0.3, 0.4; k = ceil(5 * 0.6) = 3.
    got = {r.valid_date: r for r in gating.conformal_set(cells, outcome, cut, alpha=0.4).collect()}
    assert [got[day(k)].labels for k in (4, 5, 6)] == ["wet", "none", "dry"] and got[day(4)].qhat == 0.3
    assert {r.labels for r in gating.conformal_set(cells, outcome, cut, alpha=0.01).collect()} == {"both"}
    curve = gating.risk_coverage_curve(cells, outcome)
    rows = sorted(curve.collect(), key=lambda r: r.bin)
    assert [r.coverage for r in rows] == sorted((r.coverage for r in rows), reverse=True) and rows[0].coverage == 1.0
    assert gating.pick_threshold(curve, 0.0).first().bin is None and gating.pick_threshold(curve, 1.0).first().bin == rows[0].bin


def test_record(spark, actions, members, outcome, zone):
    summary = uncertainty.ensemble_summary(members)
    gated = gating.confidence_gate(summary, decisions.decision_stability(members, summary, actions))
    limits = recommendation.limitations(summary, uncertainty.fuse_sources(summary, spark.createDataFrame([(1, 5, 0.5, 0.1)], "zone_id int, n long, fraction double, se double")), reliability.reliability_table(summary, outcome))
    flags = {r.zone_id: r.flags for r in limits.collect()}
    assert flags[2] == ["few_members", "few_observations", "no_segmentation"] and flags[1] == ["few_members", "poorly_calibrated"]
    exposure = spark.createDataFrame([(1, 1, 10.0)], "zone_id int, asset_id long, population double")
    parts = {
        "gated": gated,
        "situation": recommendation.situation(summary, exposure),
        "rationale": spark.createDataFrame([(1, DAY, 1, "s", 1.0)], "zone_id int, valid_date date, rank int, sensor string, distance double"),
        "confidence": recommendation.confidence(gated, uncertainty.ensemble_interval(members)),
        "alternatives": recommendation.alternatives(summary, actions),
        "limitations": limits,
        "needs_human": recommendation.needs_human(gated, limits, spark.createDataFrame([], "zone_id int, valid_date date, labels string")),
        "context": recommendation.add_context(summary, zone, exposure, spark.createDataFrame([], "zone_id int, resource_id long, capacity double")),
    }
    got = by_zone(recommendation.recommendation(parts))
    assert got[2].gate == "abstain" and got[2].action is None and len(got[2].record.alternatives) == 2
    assert got[1].record.situation.expected_affected == 5.0 and got[1].record.context.assets == 1 and got[3].record.context.population == 0.0
    assert got[1].record.verify.needs_human and got[1].record.verify.reason == "gate is verify"
    assert '"situation"' in recommendation.as_json(recommendation.recommendation(parts)).first().record


def test_rationale_and_situation(spark):
    features = spark.createDataFrame([(1, DAY, s, v, 10.0) for s, v in (("c", 12.0), ("a", 12.0), ("b", 5.0))], "zone_id int, valid_date date, sensor string, mean_value double, week_mean double")
    assert [(r.rank, r.sensor) for r in recommendation.rationale(features).orderBy("rank").collect()] == [(1, "b"), (2, "a")]
    cells = spark.createDataFrame([(1, day(0), 0.2), (1, day(1), 0.5), (1, day(3), 0.6)], CELL)
    exposure = spark.createDataFrame([(1, 1, 10.0)], "zone_id int, asset_id long, population double")
    got = {r.valid_date: r for r in recommendation.situation(cells, exposure).collect()}
    assert got[day(1)].change == pytest.approx(0.3) and got[day(3)].change is None and got[day(1)].expected_affected == 5.0


def test_trial(spark):
    rows = [(1, 1, "uncertainty", 1, 1, 2.0), (2, 1, "uncertainty", 0, 0, 4.0), (3, 3, "uncertainty", 0, 1, 6.0), (4, 2, "point", 1, 0, 1.0), (5, 4, "point", 1, 1, 1.0)]
    trial = spark.createDataFrame(rows, "trial_id long, participant_id long, arm string, ai_correct int, accepted int, decision_seconds double")
    got = {r.arm: r for r in communication.arm_summary(trial).collect()}
    assert got["uncertainty"].right_reliance == pytest.approx(2 / 3) and got["uncertainty"].over_reliance == 0.5 and got["point"].over_reliance is None and got["point"].under_reliance == 0.5
    contrast = communication.arm_contrast(trial).first()
    assert (contrast.n_a, contrast.n_b, contrast.difference) == (2, 2, 0.0) and contrast.se == pytest.approx(math.sqrt(0.5 / 2 + 0.5 / 2))


def test_pushdown(spark, sf_dir):
    """Only the columns asked for reach the scan."""
    from rivulet.plans.recommend import Plan

    plan = Plan(spark, sf_dir).tables.outcome._jdf.queryExecution().executedPlan().toString()
    schema = plan[plan.index("ReadSchema") :]
    assert "props" not in schema and "event_type" not in schema


def test_unusable_values_go(spark, tmp_path):
    """Null, NaN and out-of-range probabilities of members and pixels are removed and counted; NaN observations flood nothing."""
    nan = float("nan")
    spark.createDataFrame(
        [(1, dt.datetime(2024, 1, 1), 1, "a", 30.0), (2, dt.datetime(2024, 1, 1), 1, "b", -80.0), (3, dt.datetime(2024, 1, 1), 1, "c", nan), (4, dt.datetime(2024, 1, 1), 1, "d", None), (5, dt.datetime(2024, 1, 1), 2, "a", nan)],
        "event_id long, ts timestamp, user_id long, event_type string, value double",
    ).write.parquet(f"{tmp_path}/events.parquet")
    spark.createDataFrame([(1, [0.5, nan, None, -0.5]), (2, None), (3, [None]), (4, [])], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    t = Tables(spark, str(tmp_path))
    assert [r.member for r in t.forecast_member.collect()] == ["a"]
    assert t.bad_probabilities.first().removed == 4 and {r.zone_id: r.removed for r in t.removed_members.collect()} == {1: 3, 2: 1}
    assert [(r.zone_id, r.flooded, r.peak) for r in t.outcome.collect()] == [(1, 0, 30.0)]
    assert t.pixel.count() == 2
    for pixels in (t.tile, t.pixel):
        rows = uncertainty.segmentation_fraction(pixels).collect()
        assert [(r.tile_id, r.n) for r in rows] == [(1, 2)] and 0 < rows[0].fraction < 1
        assert [(r.tile_id, r.tp, r.tn) for r in reliability.segmentation_scores(pixels).collect()] == [(1, 1, 1), (-1, 1, 1)]
        assert len(uncertainty.segmentation_ambiguity(pixels).collect()) == 1


def test_removed_probabilities_are_a_limitation(spark, members, outcome):
    summary = uncertainty.ensemble_summary(members)
    fused = uncertainty.fuse_sources(summary, spark.createDataFrame([(1, 5, 0.5, 0.1)], "zone_id int, n long, fraction double, se double"))
    first = summary.orderBy("zone_id", "valid_date").first()
    removed = spark.createDataFrame([(first.zone_id, first.valid_date, 2)], "zone_id int, valid_date date, removed long")
    limits = recommendation.limitations(summary, fused, reliability.reliability_table(summary, outcome), removed)
    assert [(r.zone_id, r.valid_date) for r in limits.where("array_contains(flags, 'probabilities_removed')").collect()] == [(first.zone_id, first.valid_date)]


def test_isotonic_by_hand(spark):
    """Pools 0.4 (rate 1) and 0.6 (rate 0.5), as rates must not fall: (2 * 1 + 2 * 0.5) / 4."""
    days = [dt.date(2024, 1, d) for d in range(1, 8)]
    p = [0.2, 0.4, 0.4, 0.6, 0.6, 0.2, 0.6]
    y = [0, 1, 1, 1, 0]
    cells = spark.createDataFrame([(1, d, x) for d, x in zip(days, p, strict=True)], "zone_id int, valid_date date, p double")
    outcome = spark.createDataFrame([(1, d, x) for d, x in zip(days, y, strict=False)], "zone_id int, valid_date date, flooded int")
    got = {r.valid_date: r.recalibrated for r in reliability.recalibrate(cells, outcome, "2024-01-06", "isotonic").collect()}
    assert got == {days[5]: pytest.approx(0.0), days[6]: pytest.approx(0.75)}


@pytest.mark.parametrize("n", [1, 2, 3, 10, 2001])
def test_exact_median(spark, n):
    rng = random.Random(n)
    rows = [(k, round(rng.choice([rng.random(), 0.5]), 3)) for k in ("a", "b") for _ in range(n)] + [("b", None)]
    got = {r.k: r.median for r in communication.exact_median(spark.createDataFrame(rows, "k string, v double"), "k", "v", accuracy=1000).collect()}
    assert got == {k: pytest.approx(statistics.median(v for x, v in rows if x == k and v is not None)) for k in ("a", "b")}


def test_conformal_coverage(spark):
    rows = [("both", 1), ("both", 0), ("wet", 1), ("wet", 0), ("none", 1)]
    cells = spark.createDataFrame([(i, dt.date(2024, 2, 1), s) for i, (s, _) in enumerate(rows)], "zone_id int, valid_date date, labels string")
    outcome = spark.createDataFrame([(i, dt.date(2024, 2, 1), y) for i, (_, y) in enumerate(rows)], "zone_id int, valid_date date, flooded int")
    got = {r.labels: (r.cells, r.flooded, r.coverage) for r in gating.conformal_coverage(cells, outcome).collect()}
    assert got == {"both": (2, 1, 1.0), "wet": (2, 1, 0.5), "none": (1, 1, 0.0), "ALL": (5, 3, pytest.approx(0.6))}


def test_bagged_forecast_equals_newton_steps(spark):
    """Each member is a ridge-regularised logistic regression on its bootstrap, fitted here by Newton's method."""
    rng = np.random.default_rng(3)
    days = [dt.date(2024, 1, 1) + dt.timedelta(days=d) for d in range(24)]
    rows = [(z, d, s, 1.0, float(rng.normal(50, 10)), float(rng.normal(40, 5))) for z in range(4) for d in days for s in ("a", "b")]
    features = spark.createDataFrame(rows, "zone_id int, valid_date date, sensor string, mean_value double, lag_value double, week_mean double")
    x = {}
    for z, d, _, _, lag, week in rows:
        x.setdefault((z, d), []).append((lag, week))
    x = {k: np.array([np.mean([a for a, _ in v]), max(a for a, _ in v), np.mean([b for _, b in v])]) for k, v in x.items()}
    y = {k: int(v[0] + rng.normal(0, 8) > 50) for k, v in x.items()}
    outcome = spark.createDataFrame([(*k, v) for k, v in y.items()], "zone_id int, valid_date date, flooded int")
    got = {(r.zone_id, r.valid_date, r.member): r.prob for r in uncertainty.bagged_forecast(features, outcome, 2, "2024-01-16", max_iter=100).collect()}
    cut = dt.date(2024, 1, 16)
    early, late = [k for k in x if k[1] < cut], [k for k in x if k[1] >= cut]
    assert set(got) == {(*k, f"bag{m}") for k in late for m in range(2)}
    for m in range(2):
        u = [int(hashlib.md5(f"{m}|{z}|{d}".encode()).hexdigest()[:8], 16) / 2**32 for z, d in early]
        w = np.array([sum(v >= b for b in POISSON_ONE) for v in u], float)
        a, t = np.array([x[k] for k in early])[w > 0], np.array([y[k] for k in early])[w > 0]
        w = w[w > 0]
        mean = (w @ a) / w.sum()
        sd = np.sqrt((w @ (a - mean) ** 2) / w.sum() * w.sum() / (w.sum() - 1))
        q, beta = np.c_[a / sd, np.ones(len(a))], np.zeros(4)
        for _ in range(50):
            p = 1 / (1 + np.exp(-q @ beta))
            ridge = 0.01 * np.array([1, 1, 1, 0])
            g = q.T @ (w * (p - t)) / w.sum() + ridge * beta
            h = (q * (w * p * (1 - p))[:, None]).T @ q / w.sum() + np.diag(ridge)
            beta -= np.linalg.solve(h, g)
        for k in late:
            want = 1 / (1 + np.exp(-(np.append(x[k] / sd, 1) @ beta)))
            assert got[(*k, f"bag{m}")] == pytest.approx(want, abs=2e-3)


def test_json_holds_the_record(spark):
    """The JSON read back is the record, on whole tables."""
    from rivulet.plans.recommend import recommend

    rows = recommend(spark, "/root/testdata/sf0.001")
    kind = rows.schema["record"].dataType.simpleString()
    back = recommendation.as_json(rows).select("zone_id", "valid_date", F.from_json("record", kind).alias("back"))
    both = rows.join(back, ["zone_id", "valid_date"])
    assert both.count() == rows.count() > 0
    assert both.where(~F.col("record").eqNullSafe(F.col("back"))).count() == 0
