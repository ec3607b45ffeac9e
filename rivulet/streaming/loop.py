"""The closed loop with whole recommendations: counts on the JVM, records by batch, drift fed back.

Three queries with versioned tables between them:

1. observations -> each once, by window, zone, sensor and salt -> counts by window, zone and sensor (two streaming
   aggregates, no Python); each batch adds what its windows hold to a table of daily counts;
2. the daily counts give beliefs, decisions and the gate, and with static tables the parts of the record:
   situation, rationale, confidence, alternatives, limitations, verification, context;
3. the drift of the forecast (H6) is a versioned table of windows with alarms; while an alarm holds, the
   second query's gate turns `act` into `verify`, from its next batch on.

Every batch reads its predecessor's table and pinned versions of the others and writes folders named
by its id, so a replayed batch gives the same rows. The daily counts hold the last days of each zone; older
days are one row a zone, so the table doesn't grow with time.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.decisions import next_best, with_actions
from ..operators.recommendation import flags_of, label_of, rationale, reason_of
from ..operators.reliability import bin_of
from ..operators.uncertainty import features_of_days
from .follow import decide_on
from .versions import Versions, complete, pinned, remove

#: Days of a zone that are kept apart: the newest and the seven that it's compared with.
DAYS = 8
#: Batches whose tables stay.
KEPT = 2
# The flags of a streamed record in the order in which they are listed.
STREAM_FLAGS = ("few_observations", "no_segmentation", "sources_disagree", "poorly_calibrated", "forecast_drift")
DAILY = "zone_id int, valid_date date, sensor string, n long, wet long, total double, last timestamp"
ALARMS = "start timestamp, n long, brier double, alarm boolean"


def stream_counts(obs: DataFrame, level: float = 120.0, window: str = "1 hour", salts: int = 8) -> DataFrame:
    """Number of values, of values at the flood level or above, their sum and the newest time, by window, zone and sensor.

    obs: has its watermark; append mode. An observation counts once while its window is open, however often it comes: the first
    aggregate holds those of a window, zone, sensor and salt as one row (a zone with most of the rows is spread over
    salts), so no row of state is kept for each event. Of an event_id that comes twice at one time with
    unlike values the smallest counts, null first. Both aggregates keep their state on the JVM. Null and NaN values count as none.
    """
    salted = obs.select("zone_id", "sensor", "ts", F.pmod(F.xxhash64("event_id"), F.lit(salts)).alias("salt"), F.struct("event_id", "ts", "value").alias("e"))
    held = salted.groupBy(F.window("ts", window).alias("w"), "zone_id", "sensor", "salt").agg(F.collect_set("e").alias("events"), F.max("ts").alias("last"))

    def add(a: Column, e: Column) -> Column:
        key, value = F.struct(e["event_id"].alias("event_id"), e["ts"].alias("ts")), e["value"]
        known = ~a["key"].eqNullSafe(key) & value.isNotNull() & ~F.isnan(value)
        one = lambda which: F.when(which, F.lit(1)).otherwise(F.lit(0)).cast("long")
        return F.struct(
            key.alias("key"), (a["n"] + one(known)).alias("n"), (a["wet"] + one(known & (value >= level))).alias("wet"), (a["total"] + F.when(known, value).otherwise(F.lit(0.0))).alias("total")
        )

    zero = F.lit(0).cast("long")
    start = F.struct(F.lit(None).cast("struct<event_id:bigint,ts:timestamp>").alias("key"), zero.alias("n"), zero.alias("wet"), F.lit(0.0).alias("total"))
    parts = held.select("w", "zone_id", "sensor", "last", F.aggregate(F.sort_array("events"), start, add).alias("s"))
    whole = parts.groupBy(F.window(F.window_time("w"), window).alias("w"), "zone_id", "sensor").agg(
        F.sum("s.n").alias("n"), F.sum("s.wet").alias("wet"), F.sum(F.when(F.col("s.n") > 0, F.col("s.total"))).alias("total"), F.max("last").alias("last")
    )
    return whole.select(F.col("w.start").alias("start"), "zone_id", "sensor", "n", "wet", "total", "last")


def daily_counts(before: DataFrame | None, windows: DataFrame, days: int = DAYS) -> DataFrame:
    """The table of DAILY with the windows added; days before a zone's last `days` become its row without a date and sensor."""
    sums = [F.sum("n").alias("n"), F.sum("wet").alias("wet"), F.sum("total").alias("total"), F.max("last").alias("last")]
    # By days before anything else, so that a stream's batch is run through once and little of it is moved.
    fresh = windows.groupBy("zone_id", F.to_date("start").alias("valid_date"), "sensor").agg(*sums)
    rows = fresh if before is None else fresh.unionByName(before)
    newest = F.max("valid_date").over(Window.partitionBy("zone_id"))
    old = F.col("valid_date").isNull() | (F.col("valid_date") <= F.date_sub(newest, days))
    rows = rows.withColumn("_old", old).select("zone_id", F.when(~F.col("_old"), F.col("valid_date")).alias("valid_date"), F.when(~F.col("_old"), F.col("sensor")).alias("sensor"), "n", "wet", "total", "last")
    return rows.groupBy("zone_id", "valid_date", "sensor").agg(*sums)


def beliefs_of(daily: DataFrame) -> DataFrame:
    """zone_id, ts, n, p, variance by all counts, the newest day, and p_before by those before it (null without any)."""
    newest = F.max("valid_date").over(Window.partitionBy("zone_id"))
    rows = daily.withColumn("newest", newest)
    earlier = F.col("valid_date").isNull() | (F.col("valid_date") < F.col("newest"))
    sums = rows.groupBy("zone_id", "newest").agg(
        F.max("last").alias("ts"), F.sum("n").alias("n"), F.sum("wet").alias("wet"), F.sum(F.when(earlier, F.col("n"))).alias("n0"), F.sum(F.when(earlier, F.col("wet"))).alias("wet0")
    )
    a, b = F.col("wet") + 1, F.col("n") - F.col("wet") + 1
    variance = a * b / ((a + b) * (a + b) * (a + b + 1))
    return sums.select("zone_id", "ts", "n", (a / (a + b)).alias("p"), variance.alias("variance"), F.col("newest").alias("valid_date"), ((F.col("wet0") + 1) / (F.col("n0") + 2)).alias("p_before"))


def alarm_now(alarms: DataFrame | None, windows: int = 1) -> Column | None:
    """Whether any of the newest windows of ALARMS has an alarm, as a constant; a table of a few rows."""
    if alarms is None:
        return None
    newest = alarms.orderBy(F.desc("start")).limit(windows)
    return F.lit(bool(newest.agg(F.max("alarm")).first()[0]))


def cautious(decided: DataFrame, alarm: Column | None) -> DataFrame:
    """Under an alarm nothing is acted on without a check."""
    return decided if alarm is None else decided.withColumn("gate", F.when((F.col("gate") == "act") & alarm, "verify").otherwise(F.col("gate")))


def records(daily: DataFrame, beliefs: DataFrame, decided: DataFrame, actions: DataFrame, static: dict[str, DataFrame], alarm: Column | None = None, k: int = 2, least_obs: int = 10, disagreement: float = 2.0, gap: float = 0.1, z: float = 1.645) -> DataFrame:
    """zone_id, ts, n, action (null on abstain), gate and the record of each zone.

    beliefs, decided: those of the daily counts, by beliefs_of, decide_on and cautious, a row a zone each;
    static: context (names, population, capacity, assets by zone), segmentation (fraction and
    se by zone), reliability (bin, mean_p, rate). A zone that one of them lacks gets what the
    others say; all have a row for each zone, or bin, at most.
    """
    rows = decided.join(beliefs.select("zone_id", "valid_date", "p_before"), "zone_id").withColumn("_bin", bin_of(F.round("p", 9), 10))
    days = daily.where("valid_date is not null and n > 0").select("zone_id", "sensor", "valid_date", F.round(F.col("total") / F.col("n"), 9).alias("mean_value"))
    why = rationale(features_of_days(days), k).join(beliefs.select("zone_id", "valid_date"), ["zone_id", "valid_date"], "left_semi")
    why = why.groupBy("zone_id").agg(F.sort_array(F.collect_list(F.struct("rank", "sensor", "distance"))).alias("rationale"))
    bad = static["reliability"].where(F.abs(F.col("mean_p") - F.col("rate")) > gap).select(F.col("bin").alias("_bin"), F.lit(True).alias("_bad"))
    rows = (
        with_actions(rows, actions).withColumn("alternatives", next_best(F.round("p", 9), k)).join(why, "zone_id", "left")
        .join(static["context"].select("zone_id", "zone_name", "district_name", "population", "capacity", "assets"), "zone_id", "left")
        .join(static["segmentation"].select("zone_id", "fraction", "se"), "zone_id", "left")
        .join(F.broadcast(bad), "_bin", "left")
    )
    sd = F.sqrt("variance")
    tests = [
        F.col("n") < least_obs,
        F.col("fraction").isNull(),
        F.coalesce(F.abs(F.col("p") - F.col("fraction")) / F.sqrt(F.greatest(F.col("variance") + F.col("se") * F.col("se"), F.lit(1e-6))) > disagreement, F.lit(False)),
        F.coalesce("_bad", F.lit(False)),
        F.lit(False) if alarm is None else alarm,
    ]
    rows = rows.withColumn("limitations", flags_of(tests, STREAM_FLAGS))
    lo, hi = F.greatest(F.col("p") - z * sd, F.lit(0.0)), F.least(F.col("p") + z * sd, F.lit(1.0))
    reason = reason_of(F.size("limitations"), lo < 0.5, "evacuation on an uncertain belief")
    record = F.struct(
        F.struct("p", (F.col("p") * F.coalesce("population", F.lit(0.0))).alias("expected_affected"), (F.col("p") - F.col("p_before")).alias("change")).alias("situation"),
        "rationale",
        F.struct(sd.alias("sd"), lo.alias("lo"), hi.alias("hi"), label_of(F.col("gate")).alias("label")).alias("confidence"),
        "alternatives",
        "limitations",
        F.struct(reason.isNotNull().alias("needs_human"), F.coalesce(reason, F.lit("none")).alias("reason")).alias("verify"),
        F.struct("zone_name", "district_name", "population", "capacity", "assets").alias("context"),
    )
    return rows.select("zone_id", "ts", "n", F.when(F.col("gate") != "abstain", F.col("action")).alias("action"), "gate", record.alias("record"))


def stored(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def publish_records(spark: SparkSession, actions: DataFrame, static: dict[str, Versions], folder: str, alarms: Versions | None = None, alarm_windows: int = 1) -> Callable[[DataFrame, int], None]:
    """A sink for windows of stream_counts: the daily counts and every zone's record after the batch, in folders named by its id."""
    tables = static | ({"alarms": alarms} if alarms is not None else {})

    def publish(batch: DataFrame, batch_id: int) -> None:
        before = [i for i in complete(spark, f"{folder}/daily") if i < batch_id]
        versions = pinned(spark, f"{folder}/pins", batch_id, tables)
        lacking = [name for name in static if versions[name] is None]
        if lacking:
            raise ValueError(f"no version of {', '.join(lacking)}")
        last = spark.read.schema(DAILY).parquet(f"{folder}/daily/batch={max(before)}") if before else None
        daily_counts(last, batch.select("start", "zone_id", "sensor", "n", "wet", "total", "last")).write.mode("overwrite").parquet(f"{folder}/daily/batch={batch_id}")
        daily = spark.read.schema(DAILY).parquet(f"{folder}/daily/batch={batch_id}")
        told = alarms.at(versions["alarms"]) if alarms is not None and versions["alarms"] is not None else None
        alarm = alarm_now(told, alarm_windows)
        # A row a zone each, written as the record uses them several times.
        beliefs = stored(beliefs_of(daily), f"{folder}/beliefs/batch={batch_id}")
        decided = stored(cautious(decide_on(beliefs.select("zone_id", "ts", "n", "p", "variance"), actions), alarm), f"{folder}/decisions/batch={batch_id}")
        stored(records(daily, beliefs, decided, actions, {name: static[name].at(versions[name]) for name in static}, alarm), f"{folder}/records/batch={batch_id}")
        old = before[: len(before) + 1 - KEPT]
        remove(spark, [f"{folder}/{kind}/batch={i}" for kind in ("daily", "beliefs", "decisions", "records", "pins") for i in old])

    return publish


def latest_records(spark: SparkSession, folder: str) -> DataFrame:
    """Every zone's newest record."""
    return spark.read.parquet(f"{folder}/records/batch={max(complete(spark, f'{folder}/records'))}")


def recommend_live(obs: DataFrame, actions: DataFrame, static: dict[str, Versions], folder: str, alarms: Versions | None = None, alarm_windows: int = 1, delay: str = "1 hour", level: float = 120.0, window: str = "1 hour"):
    """Starts observations -> counts -> records in `folder`; each observation counts once within its window and the watermark's delay."""
    counts = stream_counts(obs.withWatermark("ts", delay), level, window)
    sink = publish_records(obs.sparkSession, actions, static, folder, alarms, alarm_windows)
    return counts.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()


def publish_alarms(alarms: Versions, kept: int = 31) -> Callable[[DataFrame, int], None]:
    """A sink for windows of stream_drift: the newest `kept` windows as a version numbered by the batch; a batch without windows makes none."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = alarms.spark
        before = [v for v in complete(spark, alarms.folder) if v < batch_id]
        rows = batch.select("start", "n", "brier", "alarm")
        if batch_id in complete(spark, alarms.folder) or rows.isEmpty():
            return
        if before:
            rows = rows.unionByName(spark.read.schema(ALARMS).parquet(f"{alarms.folder}/version={max(before)}"))
        alarms.write(rows.orderBy(F.desc("start")).limit(kept).coalesce(1), batch_id)

    return publish


def watch_drift(drift: DataFrame, alarms: Versions, checkpoint: str):
    """Starts drift -> versions of the alarms."""
    return drift.writeStream.outputMode("append").foreachBatch(publish_alarms(alarms)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
