"""Input tables: the given Parquet tables and the flood tables derived from them.

Every derived table is declared once, as a DataFrame; probabilities that are null,
NaN or outside [0, 1] are removed, of members and of pixels, and can be counted
(`bad_probabilities`, `removed_members`). Observations without a finite value say nothing
of an outcome.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import exact
from .scratch import held

# Actions with their fixed cost, loss if it floods and loss if it doesn't.
ACTIONS = [
    ("evacuate", 40.0, 5.0, 0.0),
    ("preposition", 20.0, 45.0, 0.0),
    ("monitor", 8.0, 75.0, 0.0),
    ("none", 0.0, 100.0, 0.0),
]
#: Days before it train or calibrate, the others test.
CUT = "2024-01-16"
FLOOD_LEVEL = 120


def is_probability(p: str = "prob"):
    return F.col(p).isNotNull() & ~F.isnan(p) & F.col(p).between(0.0, 1.0)


def read(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def outcome_of(peaks: DataFrame) -> DataFrame:
    """Whether it flooded, and the rounded peak; peaks: the highest known value of each zone and day."""
    return peaks.select("zone_id", "valid_date", F.when(F.col("highest") >= FLOOD_LEVEL, 1).otherwise(0).alias("flooded"), F.round("highest", 6).alias("peak"))


@dataclass
class Tables:
    """The flood tables over a folder of Parquet tables; each is a plan, nothing runs here."""

    spark: SparkSession
    folder: str

    def read(self, name: str) -> DataFrame:
        return read(self.spark, self.folder, name)

    @cached_property
    def observation(self) -> DataFrame:
        """event_id, ts, zone_id, sensor, value; ts as a timestamp, which watermarks need."""
        return self.read("events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 25).cast("int").alias("zone_id"), F.col("event_type").alias("sensor"), "value")

    @cached_property
    def by_sensor(self) -> DataFrame:
        """Number, mean and largest known value of each zone, day and sensor: all that the forecast, its features and the outcome need of the events."""
        # NaN would be the largest value.
        known = F.when(~F.isnan("value"), F.col("value"))
        daily = self.observation.groupBy("zone_id", F.to_date("ts").alias("valid_date"), "sensor")
        return daily.agg(F.count("*").alias("n_obs"), F.avg("value").alias("mean"), F.max(known).alias("peak"))

    def read_once(self) -> Tables:
        """Writes by_sensor, for plans that use it many times: the events are read once, the outcome's peaks come from there, too."""
        self.by_sensor = held(self.by_sensor)
        self.outcome = outcome_of(self.by_sensor.where("peak is not null").groupBy("zone_id", "valid_date").agg(F.max("peak").alias("highest")))
        return self

    @cached_property
    def raw_members(self) -> DataFrame:
        return self.by_sensor.select("zone_id", "valid_date", F.col("sensor").alias("member"), F.round(F.col("mean") / (F.col("mean") + 50.0), 6).alias("prob"), "n_obs")

    @cached_property
    def daily_means(self) -> DataFrame:
        """zone_id, sensor, valid_date, mean_value; what features are made of."""
        return self.by_sensor.select("zone_id", "sensor", "valid_date", exact(F.col("mean")).alias("mean_value"))

    @cached_property
    def forecast_member(self) -> DataFrame:
        return self.raw_members.where(is_probability())

    @cached_property
    def bad_probabilities(self) -> DataFrame:
        return self.raw_members.agg(F.count(F.when(~F.coalesce(is_probability(), F.lit(False)), 1)).alias("removed"))

    @cached_property
    def removed_members(self) -> DataFrame:
        """zone_id, valid_date and how many members of the cell were removed."""
        return self.raw_members.where(~F.coalesce(is_probability(), F.lit(False))).groupBy("zone_id", "valid_date").agg(F.count("*").alias("removed"))

    @cached_property
    def outcome(self) -> DataFrame:
        # NaN would be the largest value.
        known = self.observation.where(F.col("value").isNotNull() & ~F.isnan("value"))
        return outcome_of(known.groupBy("zone_id", F.to_date("ts").alias("valid_date")).agg(F.max("value").alias("highest")))

    @cached_property
    def zone(self) -> DataFrame:
        nation, region = self.read("nation"), self.read("region")
        joined = nation.join(region, nation.n_regionkey == region.r_regionkey)
        return joined.select(
            F.col("n_nationkey").cast("int").alias("zone_id"), F.col("n_name").alias("zone_name"), F.col("r_regionkey").cast("int").alias("district_id"), F.col("r_name").alias("district_name")
        )

    @cached_property
    def exposure(self) -> DataFrame:
        return self.read("customer").select(F.col("c_nationkey").cast("int").alias("zone_id"), F.col("c_custkey").alias("asset_id"), F.greatest("c_acctbal", F.lit(0.0)).alias("population"))

    @cached_property
    def resource(self) -> DataFrame:
        return self.read("supplier").select(F.col("s_nationkey").cast("int").alias("zone_id"), F.col("s_suppkey").alias("resource_id"), F.greatest("s_acctbal", F.lit(0.0)).alias("capacity"))

    @cached_property
    def trial(self) -> DataFrame:
        return self.read("orders").select(
            F.col("o_orderkey").alias("trial_id"),
            F.col("o_custkey").alias("participant_id"),
            F.when(F.col("o_custkey") % 2 == 0, "point").otherwise("uncertainty").alias("arm"),
            F.when(F.col("o_orderstatus") != "F", 1).otherwise(0).alias("ai_correct"),
            F.when(F.col("o_totalprice") >= 200000, 1).otherwise(0).alias("accepted"),
            F.round(F.col("o_totalprice") / 10000.0, 6).alias("decision_seconds"),
        )

    @cached_property
    def tile(self) -> DataFrame:
        """Tiles of 8 x 8 pixels, each with the array of its pixels: probability of water, and whether there was water."""

        def pixel(x, i):
            logit = x.cast("double")
            noise = (((F.col("vec_id") * 31 + i * 17) % 101) / F.lit(101.0) - 0.5) * 0.2
            return F.struct(i.alias("pixel_id"), F.round(1 / (1 + F.exp(-12 * logit)), 6).alias("prob"), F.when(logit + noise > 0, 1).otherwise(0).alias("wet"))

        valid = lambda x: F.coalesce(x["prob"].between(0.0, 1.0) & ~F.isnan(x["prob"]), F.lit(False))
        return self.read("embeddings").select(F.col("vec_id").alias("tile_id"), F.filter(F.transform("embedding", pixel), valid).alias("pixels"))

    @cached_property
    def pixel(self) -> DataFrame:
        """The pixels of the tiles, a row each."""
        return self.tile.select("tile_id", F.explode("pixels").alias("x")).select("tile_id", "x.*")

    @cached_property
    def action_cost(self) -> DataFrame:
        """Four rows, fixed."""
        return self.spark.createDataFrame(ACTIONS, "action string, fixed_cost double, loss_if_flood double, loss_if_dry double")
