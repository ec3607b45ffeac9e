"""What became of each forecast: matched, late or missing, told once.

An outcome within `within` of a forecast matches it, one within `grace` after that is late;
without either the forecast is missing. Events are keyed by zone, slot of time and salt: a slot is as
long as a forecast can wait, so a forecast stands in its own slot and an outcome in its own and the one
before. An event-time timer ends a slot when the watermark has passed all that can count in it, tells its
forecasts and drops its state. State is bounded by two slots of rows, however long the stream runs, and
a zone with most of the events is spread over its slots and salts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

HOUR = 3_600_000_000
TOLD = "forecast_id long, zone_id int, forecast_us long, forecast_value double, outcome_id long, outcome_us long, outcome_value double, status string"


def both_sides(forecasts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """One stream of both kinds of events; the watermark is that of the parts."""
    side = lambda rows, is_forecast: rows.select("event_id", "zone_id", "ts", "value", F.lit(is_forecast).alias("is_forecast"))
    return side(forecasts, True).unionByName(side(outcomes, False))


def ledger_processor(within: int, reach: int) -> StatefulProcessor:
    """The stateful processor of stream_outcome_ledger, made in here so that it's sent to the workers whole."""

    class Ledger(StatefulProcessor):
        """Forecasts and outcomes of a zone's slot until its timer ends it."""

        def init(self, handle: StatefulProcessorHandle) -> None:
            self.handle = handle
            self.events = handle.getListState("events", "is_forecast boolean, us long, id long, value double")

        def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            if not self.events.exists():
                self.handle.registerTimer((key[1] + 2) * reach // 1000)
            for batch in rows:
                values = batch["value"].astype(object).where(batch["value"].notna(), None)
                self.events.appendList(list(zip(batch["is_forecast"].tolist(), batch["us"].tolist(), batch["event_id"].tolist(), values.tolist(), strict=True)))
            return iter([])

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
            # Of events at one time the smaller id comes first.
            events = sorted((tuple(e) for e in self.events.get()), key=lambda e: e[:3])
            self.events.clear()
            forecasts, outcomes = ([e[1:] for e in events if e[0] == kind] for kind in (True, False))
            at, told = [o[0] for o in outcomes], []
            from bisect import bisect_right

            for us, i, value in forecasts:
                k = bisect_right(at, us)
                us_o, id_o, value_o = outcomes[k] if k < len(outcomes) and at[k] <= us + reach else (None, None, None)
                status = "missing" if us_o is None else "matched" if us_o <= us + within else "late"
                told.append((i, key[0], us, value, id_o, us_o, value_o, status))
            if told:
                frame = pd.DataFrame(told, columns=[c.split()[0] for c in TOLD.split(", ")])
                yield frame.astype({"outcome_id": "Int64", "outcome_us": "Int64", "forecast_value": "Float64", "outcome_value": "Float64"})

        def close(self) -> None:
            pass

    return Ledger()


def stream_outcome_ledger(events: DataFrame, within_us: int = HOUR, grace_us: int = 5 * HOUR, salts: int = 1) -> DataFrame:
    """forecast_id, zone_id, forecast_ts, forecast_value, outcome_id, outcome_ts, outcome_value, status of each forecast of `both_sides`, once.

    events: has its watermark. The outcome is the first one after the forecast; an outcome
    exactly `within_us` after it still matches. Rows without a zone or a time take no part. Salts
    split a zone with too many rows in a slot; each gets all outcomes of the zone.
    """
    reach = within_us + grace_us
    us = F.unix_micros("ts")
    rows = events.where("zone_id is not null and ts is not null").select("event_id", "zone_id", "ts", "value", "is_forecast", us.alias("us"), F.floor(us / F.lit(reach)).alias("own"))
    # Forecasts are dealt to salts, outcomes go to all of them, and to the slot of the forecasts before.
    slots = F.when(F.col("is_forecast"), F.array("own")).otherwise(F.array("own", F.col("own") - 1))
    dealt = F.when(F.col("is_forecast"), F.array(F.pmod(F.xxhash64("event_id"), F.lit(salts)).cast("int"))).otherwise(F.array(*(F.lit(s) for s in range(salts))))
    rows = rows.select("event_id", "zone_id", "ts", "value", "is_forecast", "us", F.explode(slots).alias("slot"), dealt.alias("salts")).select("*", F.explode("salts").alias("salt")).drop("salts")
    told = rows.groupBy("zone_id", "slot", "salt").transformWithStateInPandas(ledger_processor(within_us, reach), TOLD, "append", "eventTime")
    return told.select(
        "forecast_id", "zone_id", F.timestamp_micros("forecast_us").alias("forecast_ts"), "forecast_value",
        "outcome_id", F.timestamp_micros("outcome_us").alias("outcome_ts"), "outcome_value", "status",
    )
