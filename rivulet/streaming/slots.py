"""Forecasts and the outcomes after them, met in one row a zone and slot of time instead of a stream-stream join.

A slot is as long as a forecast waits (`within`). One streaming aggregate gathers what meets in a slot, on the JVM, and
tells it once the watermark has passed the slot; a stream-stream join would look its state up row by row, for each
pair that could be. Pairs are then opened from the row, and sums over pairs come from running sums, without a pair.

All take one stream of both kinds, with its watermark: event_id, zone_id, ts, value, is_forecast. Rows without a zone
or a time take no part. A row holds what a zone has in two slots; salts spread the forecasts of a fuller one over several
rows, each of which has all outcomes.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_slots(events: DataFrame, within: str) -> tuple[DataFrame, Column]:
    """The events in each of the two windows of two slots that hold them (column w), and whether they stand in the second half of it."""
    slot = pd.Timedelta(within) // pd.Timedelta(microseconds=1)
    rows = events.where("zone_id is not null and ts is not null").select("event_id", "zone_id", "ts", "value", "is_forecast", F.window("ts", f"{2 * slot} microseconds", f"{slot} microseconds").alias("w"))
    return rows, F.unix_micros("ts") >= F.unix_micros("w.start") + F.lit(slot)


def dealt(rows: DataFrame, salts: int) -> DataFrame:
    """Forecasts go to one salt, outcomes to all."""
    own = F.when(F.col("is_forecast"), F.array(F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))).otherwise(F.array(*(F.lit(s) for s in range(salts))))
    return rows.withColumn("salt", F.explode(own))


def stream_pairs(events: DataFrame, within: str = "1 hour", missing: bool = False, salts: int = 1) -> DataFrame:
    """The rows of follow.stream_outcome_join; with `missing`, forecasts that no outcome followed stay, with null outcomes.

    A forecast stands in the first half of its window, so it meets the outcomes of its own slot and of the next.
    """
    rows, second = in_slots(events, within)
    event = F.struct("ts", "event_id", "value")
    held = dealt(rows.where(~F.col("is_forecast") | ~second), salts).groupBy("zone_id", "w", "salt").agg(
        F.collect_list(F.when(F.col("is_forecast"), event)).alias("forecasts"), F.collect_list(F.when(~F.col("is_forecast"), event)).alias("outcomes")
    )
    opened = held.select("zone_id", F.explode("forecasts").alias("f"), "outcomes")
    near = F.filter("outcomes", lambda o: (o["ts"] > F.col("f.ts")) & (o["ts"] <= F.col("f.ts") + F.expr(f"interval {within}")))
    pairs = opened.select("zone_id", "f", (F.explode_outer if missing else F.explode)(near).alias("o"))
    return pairs.select(
        F.col("f.event_id").alias("forecast_id"), "zone_id", F.col("f.ts").alias("forecast_ts"), F.col("f.value").alias("forecast_value"),
        F.col("o.event_id").alias("outcome_id"), F.col("o.ts").alias("outcome_ts"), F.col("o.value").alias("outcome_value"),
    )


def stream_status(events: DataFrame, within: str = "1 hour", salts: int = 1) -> DataFrame:
    """The rows of follow.stream_outcome_status."""
    return stream_pairs(events, within, True, salts).withColumn("status", F.when(F.col("outcome_id").isNull(), "missing").otherwise("matched"))


def stream_drift(events: DataFrame, batch_brier: float, alarm_ratio: float = 1.5, level: float = 120.0, window: str = "1 day", within: str = "1 hour", salts: int = 1) -> DataFrame:
    """The rows of follow.stream_drift over all pairs, without making a pair: the work grows with the events, not with the pairs.

    The error of an outcome y against the forecasts p that it follows is sum(p * p) - 2 * y * sum(p) + y * y * n, so each
    outcome needs the running sums of the forecasts that wait at its time: a forecast enters them at its time and leaves
    `within` later. An outcome stands in the second half of its window only. `window` is a multiple of `within`.
    A pair with an unknown value counts in n, but has no error. An event that comes again while its window is open
    counts once, without a row of state for each event; of unlike values at one time the smallest counts, null first.
    """
    if pd.Timedelta(window) % pd.Timedelta(within):
        raise ValueError(f"{window} is no multiple of {within}")
    rows, second = in_slots(events, within)
    rows = dealt(rows.withColumn("second", second).where(F.col("is_forecast") | F.col("second")), salts)
    p = F.col("value") / (F.col("value") + 50.0)
    x = F.when(F.col("is_forecast"), p).otherwise(F.when(F.col("value").isNotNull(), (F.col("value") >= level).cast("double")))
    before = F.col("is_forecast") & ~F.col("second")
    # At one time the outcome comes first: it follows none that enters then, and one that leaves then it still does.
    step = F.when(~F.col("is_forecast"), 0).when(before, -1).otherwise(1)
    at = F.when(before, F.col("ts") + F.expr(f"interval {within}")).otherwise(F.col("ts"))
    rows = rows.select("zone_id", "w", "salt", F.struct(at.alias("at"), F.col("is_forecast").alias("later"), step.alias("step"), "event_id", x.alias("x")).alias("e"))
    held = rows.groupBy("zone_id", "w", "salt").agg(F.sort_array(F.collect_set("e")).alias("events"))
    same = lambda e, f: F.struct(e["at"], e["later"], e["step"], e["event_id"]).eqNullSafe(F.struct(f["at"], f["later"], f["step"], f["event_id"]))
    held = held.select("w", F.filter("events", lambda e, i: (i == 0) | ~same(e, F.get("events", i - 1))).alias("events"))

    def add(a: Column, e: Column) -> Column:
        x, outcome = e["x"], e["step"] == 0
        good, step = x.isNotNull() & ~F.isnan(x), e["step"]
        told = outcome & x.isNotNull()
        error = F.when(a["nan"] > 0, F.lit(float("nan"))).otherwise(a["q"] - 2 * x * a["p"] + x * a["k"])
        moved = lambda name, y: (a[name] + F.when(~outcome & good, step * y).otherwise(F.lit(0.0))).alias(name)
        count = lambda name, which: (a[name] + F.when(which, step.cast("long")).otherwise(F.lit(0).cast("long"))).alias(name)
        return F.struct(
            count("n", ~outcome), count("k", ~outcome & good), count("nan", ~outcome & F.coalesce(F.isnan(x), F.lit(False))), moved("p", x), moved("q", x * x),
            (a["pairs"] + F.when(outcome, a["n"]).otherwise(F.lit(0).cast("long"))).alias("pairs"),
            (a["told"] + F.when(told, a["k"] + a["nan"]).otherwise(F.lit(0).cast("long"))).alias("told"),
            (a["error"] + F.when(told & (a["k"] + a["nan"] > 0), error).otherwise(F.lit(0.0))).alias("error"),
        )

    zero = F.lit(0).cast("long")
    none = F.struct(*(zero.alias(x) for x in ("n", "k", "nan")), *(F.lit(0.0).alias(x) for x in ("p", "q")), zero.alias("pairs"), zero.alias("told"), F.lit(0.0).alias("error"))
    # Those that leave in the window wait from its start.
    enter = lambda e: F.struct(*(F.lit(1).alias("step") if f == "step" else e[f].alias(f) for f in ("at", "later", "step", "event_id", "x")))
    start = F.aggregate(F.filter("events", lambda e: e["step"] == -1), none, lambda a, e: add(a, enter(e)))
    sums = held.select("w", F.aggregate("events", start, add).alias("s"))
    by = sums.groupBy(F.window(F.window_time("w"), window).alias("day")).agg(F.sum("s.pairs").alias("n"), (F.sum("s.error") / F.nullif(F.sum("s.told"), F.lit(0))).alias("brier")).where("n > 0")
    return by.select(F.col("day.start").alias("start"), "n", "brier", (F.col("brier") > alarm_ratio * batch_brier).alias("alarm"))
