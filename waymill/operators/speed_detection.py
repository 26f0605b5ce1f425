"""Speed detection: anomaly scores of points by motion prediction or by speed statistics, and their evaluation against truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.constants import SpeedDetection
from ..functions.quality import ramp
from .asof import nearest
from .observations import ordered, steps, whole

MODES = {0: "off", 1: "three_sigma", 2: "prediction"}


def reset(points: DataFrame) -> DataFrame:
    return points.withColumns({"trusted": F.lit(True), "trust_reason": F.lit(0), "quality_score": F.lit(1.0)})


def prediction(points: DataFrame, o: SpeedDetection = SpeedDetection()) -> DataFrame:
    """Each point against the raw point before it moved by its velocity; one lag window, no recursion."""
    prev = {c: F.lag(c).over(ordered()) for c in ("ts_ms", "x", "y", "v_e", "v_n")}
    dt = (F.col("ts_ms") - prev["ts_ms"]) / 1000.0
    dx, dy = F.col("x") - (prev["x"] + prev["v_e"] * dt), F.col("y") - (prev["y"] + prev["v_n"] * dt)
    residual = F.sqrt(dx * dx + dy * dy)
    out = points.withColumn("residual_m", F.when((dt > o.min_dt) & (dt <= o.max_dt) & geo.is_finite(residual), residual))
    r = F.col("residual_m")
    return out.withColumns(
        {
            "trusted": F.coalesce(r <= o.hard_m, F.lit(True)),
            "trust_reason": F.when(r > o.hard_m, 20).otherwise(0),
            "quality_score": F.when(r.isNull(), 1.0).otherwise(ramp(r, o.soft_m, o.hard_m, o.floor)),
        }
    )


def three_sigma(points: DataFrame, o: SpeedDetection = SpeedDetection()) -> DataFrame:
    """Each speed against its trajectory's mean and sample deviation; left as it is with fewer than three speeds or hardly any deviation."""
    stepped = steps(points)
    speed = F.when((F.col("dt_s") > o.min_dt) & (F.col("dt_s") <= o.max_dt) & geo.is_finite("step_m"), F.col("step_m") / F.col("dt_s"))
    out = stepped.withColumn("speed_mps", speed)
    out = out.withColumns({"_mean": F.avg("speed_mps").over(whole()), "_sigma": F.stddev_samp("speed_mps").over(whole()), "_n": F.count("speed_mps").over(whole())})
    judged = (F.col("_n") >= 3) & (F.col("_sigma") >= 1e-6) & F.col("speed_mps").isNotNull()
    out = out.withColumn("residual_m", F.when(judged, F.abs(F.col("speed_mps") - F.col("_mean"))))
    r, soft, hard = F.col("residual_m"), o.soft_sigma * F.col("_sigma"), o.hard_sigma * F.col("_sigma")
    return out.withColumns(
        {
            "trusted": F.coalesce(r <= hard, F.lit(True)),
            "trust_reason": F.when(r > hard, 10).otherwise(0),
            "quality_score": F.when(r.isNull(), 1.0).otherwise(ramp(r, soft, hard, o.floor)),
        }
    ).drop("_mean", "_sigma", "_n", "dt_s", "step_m")


def detect(points: DataFrame, mode: int = 2, o: SpeedDetection = SpeedDetection()) -> DataFrame:
    """By mode: 1 three_sigma, 2 prediction, anything else off."""
    return three_sigma(points, o) if mode == 1 else prediction(points, o) if mode == 2 else reset(points)


def evaluation_rows(points: DataFrame, truth: DataFrame, o: SpeedDetection = SpeedDetection()) -> DataFrame:
    """traj_id, seq, ts_ms, error_m, truth_abnormal, sd_abnormal of every point with a truth row in reach."""
    order = [c for c in ("seq",) if c in truth.columns]  # of truth rows with one time the later counts
    joined = nearest(points, truth.select("traj_id", *order, "ts_ms", F.col("lat").alias("t_lat"), F.col("lon").alias("t_lon")), ("t_lat", "t_lon"), o.tolerance_ms, tie="later")
    ok = F.col("m_ts").isNotNull() & geo.is_finite("t_lat") & geo.is_finite("t_lon") & geo.is_finite("lat") & geo.is_finite("lon")
    error = geo.haversine(F.col("lat"), F.col("lon"), F.col("t_lat"), F.col("t_lon"))
    out = joined.where(ok).withColumn("error_m", error)
    return out.select(
        "traj_id", "seq", "ts_ms", "error_m", (F.col("error_m") > o.truth_error_m).alias("truth_abnormal"), (~F.col("trusted") | (F.col("quality_score") < o.abnormal_quality)).alias("sd_abnormal"), "trusted", "quality_score"
    )


def evaluate(points: DataFrame, truth: DataFrame, o: SpeedDetection = SpeedDetection()) -> DataFrame:
    """One row of confusion counts, rates and errors; a rate over nothing is 0."""
    t, s = F.col("truth_abnormal"), F.col("sd_abnormal")
    counts = evaluation_rows(points, truth, o).agg(
        F.count("*").alias("n"),
        F.count_if(t & s).alias("tp"),
        F.count_if(~t & s).alias("fp"),
        F.count_if(t & ~s).alias("fn"),
        F.count_if(~t & ~s).alias("tn"),
        F.coalesce(F.sqrt(F.avg(F.col("error_m") * F.col("error_m"))), F.lit(0.0)).alias("rmse_m"),
        F.coalesce(F.max("error_m"), F.lit(0.0)).alias("max_m"),
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    rated = counts.withColumns({"recall": share(tp, tp + fn), "precision": share(tp, tp + fp), "abnormal_share": share(tp + fp, F.col("n"))})
    return rated.withColumn("f1", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
