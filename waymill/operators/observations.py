"""Row-wise and windowed operators over observations: frames, projection to vehicle states, time windows, steps, chains, headings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.constants import EXCLUDE_WINDOWS, KEEP_WINDOW
from ..functions.quality import valid_speed


def ordered() -> WindowSpec:
    """A trajectory's rows in their order."""
    return Window.partitionBy("traj_id").orderBy("seq")


def whole() -> WindowSpec:
    return Window.partitionBy("traj_id")


def local_ref(points: DataFrame, by: tuple[str, ...] = ("traj_id",), guard: bool = False) -> DataFrame:
    """lat0, lon0, cos0 per group: the centroid of finite points; (0, 0, 1) without any. guard: a cosine near 0 becomes 1."""
    ok = geo.is_finite("lat") & geo.is_finite("lon")
    mean = points.groupBy(*by).agg(F.avg(F.when(ok, F.col("lat"))).alias("lat0"), F.avg(F.when(ok, F.col("lon"))).alias("lon0"))
    cos0 = F.cos(F.radians("lat0"))
    if guard:
        cos0 = F.when(F.abs(cos0) < 1e-9, 1.0).otherwise(cos0)
    return mean.select(*by, F.coalesce("lat0", F.lit(0.0)).alias("lat0"), F.coalesce("lon0", F.lit(0.0)).alias("lon0"), F.coalesce(cos0, F.lit(1.0)).alias("cos0"))


def with_frame(points: DataFrame, ref: tuple[float, float] | None = None) -> DataFrame:
    """x, y in the given frame, or in that of each trajectory's centroid (an aggregate over the window; no join)."""
    if ref:
        lat0, lon0 = F.lit(ref[0]), F.lit(ref[1])
    else:
        ok = geo.is_finite("lat") & geo.is_finite("lon")
        lat0, lon0 = (F.coalesce(F.avg(F.when(ok, F.col(c))).over(whole()), F.lit(0.0)) for c in ("lat", "lon"))
        points = points.withColumns({"lat0": lat0, "lon0": lon0})
        lat0, lon0 = F.col("lat0"), F.col("lon0")
    return points.withColumns({"x": geo.to_x(F.col("lon"), lat0, lon0), "y": geo.to_y(F.col("lat"), lat0)}).drop("lat0", "lon0")


def fill_xy(points: DataFrame, ref: tuple[float, float]) -> DataFrame:
    """x, y filled where missing only."""
    lat0, lon0 = F.lit(ref[0]), F.lit(ref[1])
    return points.withColumns({"x": F.coalesce("x", geo.to_x(F.col("lon"), lat0, lon0)), "y": F.coalesce("y", geo.to_y(F.col("lat"), lat0))})


def car_points(observations: DataFrame, ref: tuple[float, float] | None = None) -> DataFrame:
    """Unified vehicle states of raw observations."""
    return with_frame(observations, ref).select(
        "traj_id", "seq", "ts_ms", "lat", "lon", "h", "x", "y", F.col("vel_e").alias("v_e"), F.col("vel_n").alias("v_n"), F.col("vel_u").alias("v_u"), "quality_score", "trusted", "trust_reason"
    )


def rejection(ts: Column, keep: tuple[int, int] = KEEP_WINDOW, exclude: tuple[tuple[int, int], ...] = EXCLUDE_WINDOWS) -> Column:
    """Why a time stamp is left out: bad_time, outside, excluded; null if it is kept. Window ends belong to the windows."""
    hit = F.lit(False)
    for low, high in exclude:
        hit = hit | ts.between(low, high)
    return F.when(ts.isNull() | (ts < 0), "bad_time").when(~ts.between(*keep), "outside").when(hit, "excluded")


def time_window_filter(observations: DataFrame, keep: tuple[int, int] = KEEP_WINDOW, exclude: tuple[tuple[int, int], ...] = EXCLUDE_WINDOWS) -> DataFrame:
    """Rows within keep and in none of exclude. Plain comparisons, so they reach the scan."""
    out = observations.where(F.col("ts_ms").between(*keep) & (F.col("ts_ms") >= 0))
    for low, high in exclude:
        out = out.where(~F.col("ts_ms").between(low, high))
    return out


def time_window_rejects(observations: DataFrame, keep: tuple[int, int] = KEEP_WINDOW, exclude: tuple[tuple[int, int], ...] = EXCLUDE_WINDOWS) -> DataFrame:
    return observations.groupBy(F.coalesce(rejection(F.col("ts_ms"), keep, exclude), F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


def exclude_by_table(observations: DataFrame, windows: DataFrame) -> DataFrame:
    """Rows in none of windows(low, high): an anti join on the hour, each window standing in every hour it touches."""
    hour = 3_600_000
    spread = windows.select("low", "high", F.explode(F.sequence(F.floor(F.col("low") / hour), F.floor(F.col("high") / hour))).alias("hour"))
    own = observations.withColumn("hour", F.floor(F.col("ts_ms") / hour))
    hit = (own["hour"] == spread["hour"]) & own["ts_ms"].between(spread["low"], spread["high"])
    return own.join(spread, hit, "left_anti").drop("hour")


def steps(points: DataFrame) -> DataFrame:
    """dt_s, and step_m: planar where both points have x, y, else along the sphere."""
    prev = {c: F.lag(c).over(ordered()) for c in ("ts_ms", "x", "y", "lat", "lon")}
    planar = F.when(geo.is_finite(prev["x"]) & geo.is_finite(prev["y"]) & geo.is_finite("x") & geo.is_finite("y"), geo.distance(F.col("x"), F.col("y"), prev["x"], prev["y"]))
    return points.withColumns({"dt_s": (F.col("ts_ms") - prev["ts_ms"]) / 1000.0, "step_m": F.coalesce(planar, geo.haversine(prev["lat"], prev["lon"], F.col("lat"), F.col("lon")))})


def chains(points: DataFrame, gap_s: int = 5) -> DataFrame:
    """chain_id from 0 within a trajectory: a new chain where whole seconds go back, stand before 0 or jump by more than gap_s."""
    sec = geo.whole_seconds("ts_ms").cast("long")
    dt = sec - F.lag(sec).over(ordered())
    opens = F.lag(sec).over(ordered()).isNotNull() & ((dt > gap_s) | (dt < 0) | (sec < 0) | (F.lag(sec).over(ordered()) < 0))
    marked = points.withColumn("_opens", F.when(opens, 1).otherwise(0))
    return marked.withColumn("chain_id", F.sum("_opens").over(ordered().rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_opens")


def observation_heading(points: DataFrame) -> DataFrame:
    """obs_heading from the point before to this one (for the first: to the next), null within a metre."""
    px, py, nx, ny = F.lag("x").over(ordered()), F.lag("y").over(ordered()), F.lead("x").over(ordered()), F.lead("y").over(ordered())
    first = F.row_number().over(ordered()) == 1
    dx = F.when(first, nx - F.col("x")).otherwise(F.col("x") - px)
    dy = F.when(first, ny - F.col("y")).otherwise(F.col("y") - py)
    return points.withColumn("obs_heading", F.when(dx * dx + dy * dy > 1.0, F.atan2(dy, dx)))


def raw_speed(points: DataFrame, low: float = 0.0, moving: float = 0.35) -> DataFrame:
    """speed_e, speed_n, speed, and speed_heading where it moves."""
    e, n = valid_speed(low)
    out = points.withColumns({"speed_e": e, "speed_n": n})
    out = out.withColumn("speed", F.sqrt(F.col("speed_e") * F.col("speed_e") + F.col("speed_n") * F.col("speed_n")))
    return out.withColumn("speed_heading", F.when(F.col("speed") > moving, F.atan2("speed_n", "speed_e")))
