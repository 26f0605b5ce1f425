"""A stand-in for trajectory data, made from the events table: the driver's tables hold none. The same rows are made in SQL in `oracles`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REF = (30.0, 120.0)
LAT_M, LON_M = 0.9e-5, 1.04e-5  # degrees to a metre, about


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "value")


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """500 rows a trajectory, a second apart, with two gaps each; eastward at 10 m/s with jitter from value. It stands still for ten rows; some
    rows lie 200 m off all roads, some go back in time, and some have no speed."""
    e, s = F.col("event_id"), F.col("event_id") % 500
    still = s.between(200, 209)
    east = F.when(still, F.lit(2130.0) + F.col("value") / F.lit(1000.0)).otherwise(F.lit(10.0) * s + F.col("value") / F.lit(10.0))
    north = F.when(e % 211 == 0, F.lit(200.0)).otherwise((e % 7) * F.lit(0.5))
    own = events(spark, sf_dir).where(~s.between(100, 109) & ~s.between(300, 306))
    return own.select(
        F.floor(e / 500.0).cast("long").alias("traj_id"),
        s.alias("seq"),
        (F.lit(1678330000000) + e * 1000 - F.when(e % 331 == 0, F.lit(3000)).otherwise(F.lit(0))).alias("ts_ms"),
        (F.lit(30.0) + north * F.lit(LAT_M)).alias("lat"),
        (F.lit(120.0) + east * F.lit(LON_M)).alias("lon"),
        (F.lit(10.0) + e % 5).alias("h"),
        F.when(e % 37 != 0, F.when(still, F.lit(0.0)).otherwise(F.lit(10.0))).alias("vel_e"),
        F.when(still, F.lit(0.0)).otherwise((e % 3 - 1) * F.lit(0.2)).alias("vel_n"),
        F.lit(0.0).alias("vel_u"),
        F.when(e % 11 != 0, F.when(still, F.lit(0.0)).otherwise(F.lit(10.0) + (e % 3) * F.lit(0.1))).alias("pha_e"),
        F.lit(0.0).alias("pha_n"),
        F.when(e % 4 == 0, F.lit(0.3)).otherwise(F.lit(1.0)).alias("quality_score"),
        (e % 6 != 0).alias("trusted"),
        F.lit(0).alias("trust_reason"),
    )


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, s = F.col("event_id"), F.col("event_id") % 500
    return events(spark, sf_dir).where(e % 13 != 0).select(
        F.floor(e / 500.0).cast("long").alias("traj_id"),
        (F.lit(1678330000000) + e * 1000 + (e % 3 - 1) * 700).alias("ts_ms"),
        (F.lit(30.0) + (e % 7) * F.lit(0.5) * F.lit(LAT_M)).alias("lat"),
        (F.lit(120.0) + (F.lit(10.0) * s + (e % 5) * F.lit(0.3)) * F.lit(LON_M)).alias("lon"),
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A matched track in the frame REF, with rows of one time, without a place and without a quality."""
    e, s = F.col("event_id"), F.col("event_id") % 500
    return events(spark, sf_dir).where(e % 10 != 0).select(
        F.floor(e / 500.0).cast("long").alias("traj_id"),
        s.alias("seq"),
        (F.lit(1678330000000) + e * 1000 + F.when(e % 29 == 0, F.lit(1000)).otherwise((e % 4) * 200)).alias("ts_ms"),
        F.when(e % 23 != 0, F.lit(10.0) * s + (e % 4) * F.lit(2.0)).alias("x"),
        F.lit(0.0).alias("y"),
        F.lit(9.0).alias("h"),
        F.when(e % 17 != 0, F.lit(0.5) + (e % 5) * F.lit(0.1)).alias("quality_score"),
        (e % 9 != 0).alias("trusted"),
    )


def roads(spark: SparkSession) -> DataFrame:
    """A literal grid: three roads eastward, 20 m apart, with a vertex every 50 m, and eleven northward, 500 m apart, with one every 20 m."""
    i = F.col("id")
    point = lambda x, y: F.struct((F.lit(30.0) + y * F.lit(LAT_M)).alias("lat"), (F.lit(120.0) + x * F.lit(LON_M)).alias("lon"), F.lit(5.0).alias("h"))
    east = F.transform(F.sequence(F.lit(0), F.lit(102)), lambda k: point(F.lit(-50.0) + F.lit(50.0) * k, F.lit(20.0) * (i - 1)))
    north = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda k: point(F.lit(500.0) * (i - 3), F.lit(-60.0) + F.lit(20.0) * k))
    return spark.range(0, 14, 1, 1).select(F.col("id").alias("road_id"), F.lit(0).alias("lane_id"), F.lit(0.0).alias("lane_offset"), F.concat(F.lit("road_"), i.cast("string")).alias("name"), F.when(i < 3, east).otherwise(north).alias("points"))
