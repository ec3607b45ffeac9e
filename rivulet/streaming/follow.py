"""Streaming updates: observations to beliefs, decisions and published recommendations.

All functions take and return streaming DataFrames (they work on batches too, but
for the stateful one). Timestamps are of type TIMESTAMP; a watermark is set once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.window import Window

from ..operators.decisions import best_at, with_actions
from ..operators.gating import gate_of
from .versions import complete as published
from .versions import remove

OBSERVATION = "event_id long, ts timestamp, zone_id int, sensor string, value double"
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def read_observations(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """A stream of Parquet files of observations, a few files a batch."""
    return spark.readStream.schema(OBSERVATION).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def stream_dedup(obs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """One row for each event_id within the watermark; state older than it goes."""
    return obs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def stream_windows(obs: DataFrame, kind: str = "tumbling", delay: str | None = "1 hour") -> DataFrame:
    """Number, mean and maximum by zone over tumbling days, days sliding by 6 hours, or sessions with gaps of 6 hours."""
    obs = obs.withWatermark("ts", delay) if delay else obs
    window = {"tumbling": lambda: F.window("ts", "1 day"), "sliding": lambda: F.window("ts", "1 day", "6 hours"), "session": lambda: F.session_window("ts", "6 hours")}[kind]()
    found = obs.groupBy("zone_id", window.alias("w")).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value"), F.max("value").alias("max_value"))
    return found.select("zone_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "mean_value", "max_value")


def belief_processor(level: float) -> StatefulProcessor:
    """The stateful processor of stream_belief.

    The class is made in here so that it's sent to the workers whole: Spark's
    driver-side worker doesn't see this package.
    """

    class Belief(StatefulProcessor):
        """Beta counts of each zone: how often values reached the flood level."""

        def __init__(self, level: float = 120.0):
            self.level = level

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.counts = handle.getValueState("counts", "wet long, dry long, last timestamp")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            wet, dry, last = self.counts.get() if self.counts.exists() else (0, 0, None)
            for batch in rows:
                high = int((batch["value"] >= self.level).sum())
                wet, dry = wet + high, dry + int(batch["value"].notna().sum()) - high
                newest = batch["ts"].max()
                last = newest.to_pydatetime() if last is None or newest > pd.Timestamp(last) else last
            self.counts.update((wet, dry, last))
            a, b = wet + 1, dry + 1
            yield pd.DataFrame({"zone_id": [key[0]], "ts": [last], "n": [wet + dry], "p": [a / (a + b)], "variance": [a * b / ((a + b) ** 2 * (a + b + 1))]})

        def close(self) -> None:
            pass

    return Belief(level)


BELIEF = "zone_id int, ts timestamp, n long, p double, variance double"


def stream_belief(obs: DataFrame, level: float = 120.0, mode: str = "update") -> DataFrame:
    """Each zone's Beta(1, 1) belief after every batch that has rows of it: mean and variance. State is two counts a zone.

    mode: that of the query; after another stateful operator it has to be append.
    """
    return obs.select("zone_id", "ts", "value").groupBy("zone_id").transformWithStateInPandas(belief_processor(level), BELIEF, mode, "none")


#: Places in a belief's distribution whose decisions are compared: standard deviations from its mean.
PLACES = (-1.5, -0.75, 0.0, 0.75, 1.5)


def decide_on(beliefs: DataFrame, actions: DataFrame, act_sd: float = 0.15) -> DataFrame:
    """Best action by zone for a batch of beliefs, and the gate of E1: act, verify or abstain.

    A belief's members are five places of its distribution, so its stability is the share
    of them with the same best action; a belief without observations has no members.
    """
    w = Window.partitionBy("zone_id").orderBy(F.desc("ts"), F.desc("n"))
    newest = beliefs.withColumn("r", F.row_number().over(w)).where("r = 1").withColumn("p", F.round("p", 9)).drop("r")
    at = lambda place: F.round(F.least(F.greatest(F.col("p") + place * F.sqrt("variance"), F.lit(0.0)), F.lit(1.0)), 9)
    rows = with_actions(newest.select("zone_id", "ts", "n", "p", "variance"), actions).withColumn("best", best_at(F.col("p")))
    agreed = sum(((best_at(at(F.lit(x)))["action"] == F.col("best.action")).cast("double") for x in PLACES), F.lit(0.0)) / len(PLACES)
    seen = F.col("n") > 0
    gate = gate_of(F.when(seen, F.round(agreed, 9)).otherwise(0.0), F.sqrt("variance"), F.when(seen, len(PLACES)).otherwise(0), act_sd=act_sd)
    return rows.select("zone_id", "ts", "n", "p", "variance", F.col("best.action").alias("action"), F.col("best.loss").alias("loss"), gate.alias("gate"))


COUNTS = "zone_id int, wet long, n long, ts timestamp, fresh boolean"


def add_beliefs(folder: str, level: float = 120.0, kept_batches: int = 2) -> Callable[[DataFrame, int], DataFrame]:
    """Adds a batch's observations to the counts of each zone and gives the beliefs of the zones that it has rows of, as stream_belief.

    Sums are partial before they are dealt by zone, so no zone's rows go to one task or to Python. Counts are
    written to a folder of the batch's id from its predecessor's, so a replay gives the same.
    """

    def add(batch: DataFrame, batch_id: int) -> DataFrame:
        spark, now = batch.sparkSession, f"{folder}/batch={batch_id}"
        before = [i for i in published(spark, folder) if i < batch_id]
        known = F.col("value").isNotNull() & ~F.isnan("value")
        rows = batch.groupBy("zone_id").agg(F.count_if(known & (F.col("value") >= level)).alias("wet"), F.count_if(known).alias("n"), F.max("ts").alias("ts")).withColumn("fresh", F.lit(True))
        if before:
            rows = rows.unionByName(spark.read.schema(COUNTS).parquet(f"{folder}/batch={max(before)}").withColumn("fresh", F.lit(False)))
        rows.groupBy("zone_id").agg(F.sum("wet").alias("wet"), F.sum("n").alias("n"), F.max("ts").alias("ts"), F.max("fresh").alias("fresh")).write.mode("overwrite").parquet(now)
        remove(spark, [f"{folder}/batch={i}" for i in before[: len(before) + 1 - kept_batches]])
        a, b = F.col("wet") + F.lit(1.0), F.col("n") - F.col("wet") + F.lit(1.0)
        return spark.read.schema(COUNTS).parquet(now).where("fresh").select("zone_id", "ts", "n", (a / (a + b)).alias("p"), (a * b / ((a + b) * (a + b) * (a + b + 1))).alias("variance"))

    return add


def stream_decide(obs: DataFrame, actions: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, delay: str | None = "1 hour"):
    """Starts dedup -> belief -> decision -> sink. Ranking isn't allowed on streams, so it happens for each batch.

    A replayed observation counts once within the watermark's delay; None leaves duplicates in. The
    zones' counts lie beside the checkpoint.
    """
    beliefs = add_beliefs(f"{checkpoint}-counts")

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(decide_on(beliefs(batch, batch_id), actions), batch_id)

    rows = (stream_dedup(obs, delay) if delay else obs).select("zone_id", "ts", "value")
    return rows.writeStream.outputMode("append").foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def follow(stream: DataFrame, actions: DataFrame, folder: str, delay: str = "1 hour"):
    """The closed loop: observations, each once, to beliefs, decisions and the newest recommendation of each zone in `folder`."""
    return stream_decide(stream, actions, publish_latest(f"{folder}/latest"), f"{folder}/checkpoint", delay)


def near_pairs(forecasts: DataFrame, outcomes: DataFrame, delay: str | None, within: str, how: str) -> DataFrame:
    """Forecasts joined with the outcomes of their zone that come at most `within` after them.

    The key is zone and slot of time, as long as a forecast waits: a forecast stands in its own slot, an outcome in its
    own and the one before. So a row meets those of two slots of its zone, not all that the state of the zone holds, and
    a zone is dealt out by its slots; each pair meets in one slot, the forecast's.
    """
    slot = lambda ts: F.floor(F.unix_micros(ts) / F.lit(pd.Timedelta(within) // pd.Timedelta(microseconds=1)))
    f = forecasts.select(F.col("event_id").alias("forecast_id"), F.col("zone_id"), F.col("ts").alias("forecast_ts"), F.col("value").alias("forecast_value"))
    o = outcomes.select(F.col("event_id").alias("outcome_id"), F.col("zone_id").alias("outcome_zone"), F.col("ts").alias("outcome_ts"), F.col("value").alias("outcome_value"))
    if delay:
        f, o = f.withWatermark("forecast_ts", delay), o.withWatermark("outcome_ts", delay)
    f, own = f.withColumn("slot", slot("forecast_ts")), slot("outcome_ts")
    o = o.withColumn("outcome_slot", F.explode(F.array(own, own - 1)))
    near = F.expr(f"zone_id = outcome_zone and slot = outcome_slot and outcome_ts > forecast_ts and outcome_ts <= forecast_ts + interval {within}")
    return f.join(o, near, how).drop("outcome_zone", "slot", "outcome_slot")


def stream_outcome_join(forecasts: DataFrame, outcomes: DataFrame, delay: str | None = "1 hour", within: str = "1 hour") -> DataFrame:
    """Forecast events with the outcome events of their zone in the next hour. Both watermarks bound the state."""
    return near_pairs(forecasts, outcomes, delay, within, "inner")


def stream_outcome_status(forecasts: DataFrame, outcomes: DataFrame, delay: str | None = "1 hour", within: str = "1 hour") -> DataFrame:
    """As stream_outcome_join, with the forecasts that no outcome followed: status is matched or missing.

    A missing one is told once the watermark has passed the time in which an outcome could come.
    """
    return near_pairs(forecasts, outcomes, delay, within, "left_outer").withColumn("status", F.when(F.col("outcome_id").isNull(), "missing").otherwise("matched"))


def stream_drift(joined: DataFrame, batch_brier: float, alarm_ratio: float = 1.5, level: float = 120.0, window: str = "1 day") -> DataFrame:
    """Brier score of each window of joined events against the batch score; an alarm above the ratio.

    An action taken may prevent a flood, so a miss here isn't by itself a false alarm of the forecast.
    """
    p = F.col("forecast_value") / (F.col("forecast_value") + 50.0)
    y = F.when(F.col("outcome_value") >= level, 1.0).otherwise(0.0)
    by = joined.groupBy(F.window("outcome_ts", window).alias("w")).agg(F.count("*").alias("n"), F.avg((p - y) * (p - y)).alias("brier"))
    return by.select(F.col("w.start").alias("start"), "n", "brier", (F.col("brier") > alarm_ratio * batch_brier).alias("alarm"))


def merge_latest(folder: str, key: list[str], order: list[str], kept_batches: int = 2) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each key, the largest by `order`.

    Every batch writes the merged table to a folder named by its batch id: a replay
    overwrites its own folder from the same predecessor, so the result stays. Of older
    tables only the last `kept_batches` remain.
    """

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        before = [i for i in published(spark, folder) if i < batch_id]
        rows = batch if not before else batch.unionByName(spark.read.schema(batch.schema).parquet(f"{folder}/batch={max(before)}"))
        value = F.struct(*order, *(c for c in batch.columns if c not in [*key, *order]))
        merged = rows.groupBy(key).agg(F.max(value).alias("v")).select(*key, "v.*").select(batch.columns)
        merged.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")
        remove(spark, [f"{folder}/batch={i}" for i in before[: len(before) + 1 - kept_batches]])

    return publish


def publish_latest(folder: str) -> Callable[[DataFrame, int], None]:
    """A sink that keeps the newest row of each zone."""
    return merge_latest(folder, ["zone_id"], ["ts", "n"])


def latest(spark: SparkSession, folder: str) -> DataFrame:
    """The newest row of each zone."""
    return spark.read.parquet(f"{folder}/batch={max(published(spark, folder))}")
