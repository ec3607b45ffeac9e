"""Registered queries: each runs an operator over whole tables and rounds its output as its SQL does."""

from __future__ import annotations

import datetime as dt
import json
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.numbers import out
from ..operators import communication, decisions, gating, quantiles, recommendation, reliability, uncertainty
from ..sources import daily
from ..sources.scratch import held, scratch
from ..sources.tables import ACTIONS, CUT, Tables
from ..streaming import follow, ledger, loop, slots
from ..streaming.versions import Versions
from .oracle import oracle_sql
from .recommend import Plan, evaluate, recommend

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def presented(df: DataFrame) -> DataFrame:
    """Doubles rounded to four places, dates as text."""
    kinds = {"double": lambda c: out(F.col(c)), "date": lambda c: F.col(c).cast("string")}
    return df.select(*(kinds[kind](c).alias(c) if kind in kinds else F.col(c) for c, kind in df.dtypes))


def query(name: str):
    def register(f: Callable[[Plan, Tables], DataFrame]) -> Query:
        QUERIES[name] = lambda spark, folder: presented((lambda plan: f(plan, plan.tables))(Plan(spark, folder)))
        return QUERIES[name]

    return register


query("a1_zone_features")(lambda p, t: p.features)
query("a2_bagged_forecast")(lambda p, t: uncertainty.bagged_forecast(p.features, t.outcome, 3, CUT))
query("a2_bagged_newton")(lambda p, t: uncertainty.bagged_newton(p.features, t.outcome, 3, CUT))
query("b1_ensemble_summary")(lambda p, t: p.cell)
query("b2_ensemble_interval")(lambda p, t: p.interval)
query("b3_entropy_split")(lambda p, t: uncertainty.entropy_split(t.forecast_member))
query("b4_exceedance")(lambda p, t: uncertainty.exceedance(t.observation))
query("b5_tile_fraction")(lambda p, t: uncertainty.segmentation_fraction(t.tile))
query("b5_zone_fraction")(lambda p, t: uncertainty.segmentation_fraction(t.tile, by_zone=True))
query("b6_segmentation_ambiguity")(lambda p, t: uncertainty.segmentation_ambiguity(t.tile))
query("b7_fuse_sources")(lambda p, t: p.fused)
query("c1_score_probabilities")(lambda p, t: reliability.score_probabilities(p.cell, t.outcome, t.zone))
query("c2_reliability_table")(lambda p, t: p.reliability)
query("c3_calibration_error")(lambda p, t: reliability.calibration_error(p.reliability))
query("c4_brier_decomposition")(lambda p, t: reliability.brier_decomposition(p.reliability))
query("c5_interval_coverage")(lambda p, t: reliability.interval_coverage(t.outcome, CUT))
query("c6_crps_ensemble")(lambda p, t: reliability.crps_ensemble(t.forecast_member, t.outcome))
query("c7_segmentation_scores")(lambda p, t: reliability.segmentation_scores(t.tile))
query("c8_recalibrate_histogram")(lambda p, t: reliability.recalibrate(p.cell, t.outcome, CUT))
query("c8_recalibrate_isotonic")(lambda p, t: reliability.recalibrate(p.cell, t.outcome, CUT, "isotonic"))
query("c8_isotonic_blocks")(lambda p, t: reliability.recalibrate_isotonic(p.cell, t.outcome, CUT))
query("b2_city_quantiles")(lambda p, t: quantiles.sketch_intervals(quantiles.merged_sketches(quantiles.quantile_sketches(t.observation), t.zone)))
query("c5_sketch_coverage")(lambda p, t: quantiles.sketch_coverage(held(quantiles.quantile_sketches(t.observation)), t.zone, CUT))
query("d1_expected_loss")(lambda p, t: decisions.expected_loss(p.cell.select("zone_id", "valid_date", "p"), t.action_cost).drop("p"))
query("d2_decide_uncertainty_aware")(lambda p, t: decisions.decide_uncertainty_aware(p.cell, t.action_cost))
query("d3_decide_deterministic")(lambda p, t: decisions.decide_deterministic(p.cell, t.action_cost))
query("d4_policy_comparison")(lambda p, t: all_dates(decisions.policy_comparison(p.policies, t.outcome, t.action_cost)))
query("d4_recalibrated_policies")(lambda p, t: all_dates(decisions.policy_comparison(p.late_policies, t.outcome, t.action_cost)))
query("d5_policy_difference_ci")(lambda p, t: decisions.policy_difference_ci(p.policies, t.outcome, t.action_cost, "aware", "deterministic"))
query("d6_propagate_linear")(lambda p, t: decisions.propagate_linear(p.cell, t.exposure, t.zone))
query("d7_propagate_monte_carlo")(lambda p, t: decisions.propagate_monte_carlo(p.drawn))
query("d8_capacity_shortfall")(lambda p, t: decisions.capacity_shortfall(p.drawn, t.resource, t.zone))
query("d9_decision_stability")(lambda p, t: p.stability)
query("e1_confidence_gate")(lambda p, t: p.gated)
query("e2_conformal_set")(lambda p, t: p.conformal)
query("e2_conformal_coverage")(lambda p, t: gating.conformal_coverage(p.conformal, t.outcome))
query("e3_risk_coverage")(lambda p, t: gating.risk_coverage_curve(p.cell, t.outcome))
query("e4_pick_threshold")(lambda p, t: gating.pick_threshold(gating.risk_coverage_curve(p.cell, t.outcome)))
query("e5_abstention_audit")(lambda p, t: gating.abstention_audit(p.gated, t.outcome, t.zone))
query("f1_situation")(lambda p, t: recommendation.situation(p.cell, t.exposure))
query("f2_rationale")(lambda p, t: recommendation.rationale(p.features))
query("f3_confidence")(lambda p, t: recommendation.confidence(p.gated, p.interval))
query("f4_alternatives")(lambda p, t: recommendation.alternatives(p.cell, t.action_cost))
query("f5_limitations")(lambda p, t: p.limits.select("zone_id", "valid_date", F.explode("flags").alias("flag")))
query("f6_needs_human")(lambda p, t: recommendation.needs_human(p.gated, p.limits, p.conformal))
query("f7_add_context")(lambda p, t: recommendation.add_context(p.cell, t.zone, t.exposure, t.resource))
query("g1_arm_summary")(lambda p, t: communication.arm_summary(t.trial))
query("g2_arm_contrast")(lambda p, t: communication.arm_contrast(t.trial))


@query("a1_features_by_day")
def _(p: Plan, t: Tables) -> DataFrame:
    """The features, built without the events of a few days that come late (every ninth), then with those days refreshed."""
    path = scratch(t.spark)
    late = (F.col("event_id") % 9 == 0) & (F.dayofmonth("ts") % 11 == 3)
    daily.build(t.observation.where(~late), path)
    daily.refresh(t.observation, path, [r[0] for r in t.observation.where(late).select(F.to_date("ts")).distinct().collect()])
    return daily.features(t.spark, path)


def all_dates(rows: DataFrame) -> DataFrame:
    return rows.withColumn("valid_date", F.coalesce(F.col("valid_date").cast("string"), F.lit("ALL")))


@query("f8_recommendation")
def _(p: Plan, t: Tables) -> DataFrame:
    """The record's main fields, flat, so that engines compare them alike."""
    r = recommend(t.spark, t.folder)
    return r.select(
        "zone_id", "valid_date", "action", "gate", F.col("record.situation.expected_affected").alias("expected_affected"), F.col("record.confidence.lo").alias("lo"), F.col("record.confidence.hi").alias("hi"),
        F.size("record.limitations").alias("n_limitations"), F.col("record.verify.needs_human").alias("needs_human"), F.col("record.context.district_name").alias("district"),
    )


QUERIES["f8_recommendation_json"] = lambda spark, folder: recommendation.as_json(recommend(spark, folder)).withColumn("valid_date", F.col("valid_date").cast("string"))


#: Spans of time that the events are fed in, files of each at least, and rows of a file (more make more files).
SPANS, FILES, FILE_ROWS = 3, 4, 1_000_000
HEARTBEAT = "heartbeat"
#: Stores of state that a stream may have on a session of fewer cores.
LEAST_STORES = 8


def feed(spark: SparkSession, folder: str) -> Callable[[], DataFrame]:
    """Reads the events, as often as asked, as a stream as they would arrive: one span of time after another, with replays, and a heartbeat at the end.

    Every seventh observation comes twice, and each span repeats the last half hour of the
    one before. The heartbeat, two days later, lets the watermark pass all windows. A batch is a
    span, however many files that takes, as the rows of a span are in no order.
    """
    events = Tables(spark, folder).observation
    path = scratch(spark)
    first, last, rows = events.agg(F.min("ts"), F.max("ts"), F.count("*")).first()
    if first is None:
        events.write.parquet(f"{path}/in")
        return lambda: follow.read_observations(spark, f"{path}/in")
    files = max(FILES, rows // FILE_ROWS)
    cuts = [first + (last - first) * k / SPANS for k in range(SPANS)] + [last + dt.timedelta(microseconds=1)]
    for k in range(SPANS):
        span = lambda lo, hi: events.where((F.col("ts") >= F.lit(lo)) & (F.col("ts") < F.lit(hi)))
        own = span(cuts[k], cuts[k + 1])
        own = own.unionByName(own.where("event_id % 7 = 0"))
        if k:
            own = own.unionByName(span(max(cuts[k] - dt.timedelta(minutes=30), cuts[k - 1]), cuts[k]))
        own.repartition(files).write.mode("append").parquet(f"{path}/in")
    beat = events.limit(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit(last + dt.timedelta(days=2)).alias("ts"), F.lit(-1).alias("zone_id"), F.lit(HEARTBEAT).alias("sensor"), F.lit(0.0).alias("value"))
    beat.write.mode("append").parquet(f"{path}/in")
    return lambda: follow.read_observations(spark, f"{path}/in", files)


def drained(stream: DataFrame) -> DataFrame:
    """Runs the stream over what is there and returns the rows that it appended; none may have come too late.

    Each batch has a folder of its own, which a repeated batch writes anew.
    """
    path = scratch(stream.sparkSession)
    ended(stream.writeStream.outputMode("append").foreachBatch(lambda batch, i: batch.write.mode("overwrite").parquet(f"{path}/out/{i}")).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start())
    return stream.sparkSession.read.schema(stream.schema).option("recursiveFileLookup", "true").parquet(f"{path}/out")


def ended(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.recentProgress and query.recentProgress[0].batchId > 0:
        raise RuntimeError("the first batches' progress is gone: set spark.sql.streaming.numRecentProgressUpdates higher")
    late = sum(state["numRowsDroppedByWatermark"] for p in query.recentProgress for state in json.loads(p.json)["stateOperators"])
    if late:
        raise RuntimeError(f"{late} rows came after the watermark")


@contextmanager
def state_store(spark: SparkSession) -> Iterator[None]:
    """Queries that start in it keep their state in RocksDB, a store a core at most; then the session's own settings hold again.

    A batch commits every store of every aggregate, so many stores of few rows would be most of its time.
    """
    partitions = "spark.sql.shuffle.partitions"
    stores = min(int(spark.conf.get(partitions)), max(spark.sparkContext.defaultParallelism, LEAST_STORES))
    own = {"spark.sql.streaming.stateStore.providerClass": follow.STATE_STORE, partitions: str(stores)}
    before = {name: spark.conf.get(name) for name in own}
    for name, value in own.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def streamed(f: Callable[[SparkSession, DataFrame], DataFrame]) -> Query:
    """A query over the events as a stream of several batches."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        with state_store(spark):
            return f(spark, feed(spark, folder)())

    return run


def once(obs: DataFrame) -> DataFrame:
    return follow.stream_dedup(obs)


def h1(spark: SparkSession, obs: DataFrame) -> DataFrame:
    return drained(once(obs)).where("zone_id >= 0").groupBy("zone_id", "sensor").agg(F.count("*").alias("events"))


def windows(kind: str, pattern: str) -> Query:
    # The watermark is set with the dedup, so the windows set none.
    return streamed(lambda spark, obs: presented(drained(follow.stream_windows(once(obs), kind, None)).withColumn("start", F.date_format("start", pattern)).drop("end")))


def h3(spark: SparkSession, obs: DataFrame) -> DataFrame:
    rows = drained(follow.stream_belief(once(obs), mode="append")).where("zone_id >= 0")
    last = rows.groupBy("zone_id").agg(F.max(F.struct("n", "p", "variance")).alias("b")).select("zone_id", "b.*")
    return last.select("zone_id", "n", out(F.col("p")).alias("p"), small(F.col("variance")).alias("variance"))


def small(x: Column) -> Column:
    return F.round(x + 1e-12, 8)


def h4(spark: SparkSession, obs: DataFrame) -> DataFrame:
    path = scratch(spark)
    actions = spark.createDataFrame(ACTIONS, "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")
    ended(follow.follow(obs, actions, path))
    rows = follow.latest(spark, f"{path}/latest").where("zone_id >= 0")
    return rows.withColumns({"p": out(F.col("p")), "variance": small(F.col("variance")), "loss": out(F.col("loss"))})


def sides(obs: DataFrame) -> DataFrame:
    """Forecasts and outcomes in one stream, with the heartbeat."""
    return obs.where(F.col("sensor").isin("view", "error", HEARTBEAT)).withColumn("is_forecast", F.col("sensor") == "view")


def both(obs: DataFrame) -> DataFrame:
    """The sides, each event once; its watermark is set."""
    return sides(once(obs))


def h5(spark: SparkSession, obs: DataFrame) -> DataFrame:
    return drained(slots.stream_pairs(both(obs)).select("forecast_id", "outcome_id", "zone_id"))


def h5_status(spark: SparkSession, obs: DataFrame) -> DataFrame:
    # -1: no outcome.
    return drained(slots.stream_status(both(obs)).where("zone_id >= 0").select("forecast_id", F.coalesce("outcome_id", F.lit(-1)).cast("long").alias("outcome_id"), "zone_id", "status"))


def h5_ledger(spark: SparkSession, obs: DataFrame) -> DataFrame:
    events = once(obs.where(F.col("sensor").isin("view", "error", HEARTBEAT)))
    rows = drained(ledger.stream_outcome_ledger(ledger.both_sides(*(events.where(F.col("sensor").isin(s, HEARTBEAT)) for s in ("view", "error"))))).where("zone_id >= 0")
    return rows.select("forecast_id", F.coalesce("outcome_id", F.lit(-1)).cast("long").alias("outcome_id"), "zone_id", "status")


def batch_brier(plan: Plan) -> float:
    """One number: the batch score that the stream is held against."""
    return reliability.score_probabilities(plan.cell, plan.tables.outcome, plan.tables.zone).where("district = 'ALL'").first()["brier"]


def drift_of(obs: DataFrame, batch: float) -> DataFrame:
    return slots.stream_drift(sides(obs.withWatermark("ts", "1 hour")), batch)


def h6(spark: SparkSession, folder: str) -> DataFrame:
    batch = batch_brier(Plan(spark, folder))
    with state_store(spark):
        rows = drained(drift_of(feed(spark, folder)(), batch))
    return presented(rows.withColumn("start", F.date_format("start", "yyyy-MM-dd")))


def h3_counts(spark: SparkSession, obs: DataFrame) -> DataFrame:
    """The beliefs of h3 from sums of two streaming aggregates."""
    windows = drained(loop.stream_counts(obs.withWatermark("ts", "1 hour"))).where("zone_id >= 0")
    found = loop.beliefs_of(loop.daily_counts(None, windows))
    return found.select("zone_id", "n", out(F.col("p")).alias("p"), small(F.col("variance")).alias("variance"))


def static_tables(plan: Plan, path: str) -> dict[str, Versions]:
    """First versions of the tables that a live record is enriched by."""
    t = plan.tables
    tables = {
        "context": recommendation.zone_context(t.zone, t.exposure, t.resource),
        "segmentation": uncertainty.segmentation_fraction(t.tile, by_zone=True),
        "reliability": plan.reliability,
    }
    found = {name: Versions(plan.tables.spark, f"{path}/static/{name}") for name in tables}
    for name, rows in tables.items():
        found[name].write(rows, 0)
    return found


def live(spark: SparkSession, folder: str, drift: bool) -> DataFrame:
    """The zones' last records after the whole feed; drift: with the alarms of the drift query, run before."""
    plan, path, read = Plan(spark, folder), scratch(spark), feed(spark, folder)
    alarms = Versions(spark, f"{path}/alarms") if drift else None
    with state_store(spark):
        if drift:
            ended(loop.watch_drift(drift_of(read(), batch_brier(plan)), alarms, f"{path}/drift-checkpoint"))
        ended(loop.recommend_live(read(), plan.tables.action_cost, static_tables(plan, path), path, alarms, ALARM_WINDOWS))
    return loop.latest_records(spark, path).where("zone_id >= 0")


#: An alarm of the drift holds for so many windows.
ALARM_WINDOWS = 7


def h7_record(spark: SparkSession, folder: str) -> DataFrame:
    """The whole record of each zone, lists as text."""
    r = live(spark, folder, drift=False)
    of = lambda name: F.col(f"record.{name}")
    listed = lambda name, field: F.array_join(F.transform(of(name), lambda x: x[field]), ",")
    return presented(r.select(
        "zone_id", "n", "action", "gate", of("situation.p").alias("p"), of("situation.expected_affected").alias("expected_affected"), of("situation.change").alias("change"),
        F.coalesce(listed("rationale", "sensor"), F.lit("")).alias("reasons"), of("confidence.sd").alias("sd"), of("confidence.lo").alias("lo"), of("confidence.hi").alias("hi"), of("confidence.label").alias("label"),
        listed("alternatives", "action").alias("alternatives"), F.element_at(of("alternatives"), 1)["extra_loss"].alias("extra_loss"), F.array_join(of("limitations"), ",").alias("limitations"),
        of("verify.needs_human").alias("needs_human"), of("verify.reason").alias("reason"), of("context.district_name").alias("district"), of("context.population").alias("population"), of("context.assets").alias("assets"),
    ))


def h6_loop(spark: SparkSession, folder: str) -> DataFrame:
    """Action, gate, flags and check of each zone with the drift's alarms fed back."""
    r = live(spark, folder, drift=True)
    return r.select("zone_id", "action", "gate", F.array_join("record.limitations", ",").alias("limitations"), F.col("record.verify.reason").alias("reason"))


QUERIES |= {
    "h1_stream_dedup": streamed(h1),
    "h2_tumbling_windows": windows("tumbling", "yyyy-MM-dd"),
    "h2_sliding_windows": windows("sliding", "yyyy-MM-dd HH:mm:ss"),
    "h2_session_windows": windows("session", "yyyy-MM-dd HH:mm:ss.SSSSSS"),
    "h3_stream_belief": streamed(h3),
    "h3_belief_counts": streamed(h3_counts),
    "h4_stream_decide": streamed(lambda spark, obs: h4(spark, obs).drop("ts")),
    "h5_outcome_join": streamed(h5),
    "h5_outcome_status": streamed(h5_status),
    "h5_outcome_ledger": streamed(h5_ledger),
    "h6_stream_drift": h6,
    "h6_closed_loop": h6_loop,
    "h7_live_record": h7_record,
    "h7_publish_latest": streamed(lambda spark, obs: h4(spark, obs).groupBy("gate").agg(F.count("*").alias("zones"), F.max(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")).alias("newest"))),
}

__all__ = ["QUERIES", "evaluate", "oracle_sql", "recommend"]
