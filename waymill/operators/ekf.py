"""Kalman fusion of GNSS observations with a matched track.

East and north never mix, so the four-state filter is two filters of two states (place, speed). The as-of join runs relationally; the fold
itself is one grouped pass per trajectory, as an accumulator that appends a row per step would copy itself each time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, quality
from ..functions.constants import Ekf
from .asof import matched


class Axis:
    """Place x and speed v with covariance (a, b; b, c)."""

    __slots__ = ("x", "v", "a", "b", "c")

    def __init__(self, x: float, v: float, o: Ekf) -> None:
        self.x, self.v, self.a, self.b, self.c = x, v, o.start_m**2, 0.0, o.start_mps**2

    def predict(self, dt: float, o: Ekf) -> None:
        self.x += self.v * dt
        self.a += 2 * dt * self.b + dt * dt * self.c + o.process_m**2 * dt * dt
        self.b += dt * self.c
        self.c += o.process_mps**2 * dt

    def place(self, z: float, r: float) -> None:
        s = self.a + r
        if r <= 0 or s <= 1e-12:
            return
        k, g, d = self.a / s, self.b / s, z - self.x
        self.x += k * d
        self.v += g * d
        self.c -= g * self.b
        self.b *= 1 - k
        self.a *= 1 - k

    def speed(self, z: float, r: float) -> None:
        s = self.c + r
        if r <= 0 or s <= 1e-12:
            return
        k, g, d = self.b / s, self.c / s, z - self.v
        self.x += k * d
        self.v += g * d
        self.a -= k * self.b
        self.b *= 1 - g
        self.c *= 1 - g


def _finite(*v: float | None) -> bool:
    return all(x is not None and np.isfinite(x) for x in v)


def fold(pdf: pd.DataFrame, o: Ekf) -> pd.DataFrame:
    """One trajectory: traj_id, seq, x, y, v_e, v_n from columns seq, ts_ms, x, y, vel_e, vel_n, gnss_scale, o_x, o_y, road_scale."""
    pdf = pdf.sort_values("seq")
    out, state, last = [], None, 0
    cols = [pdf[c].tolist() for c in ("seq", "ts_ms", "x", "y", "vel_e", "vel_n", "gnss_scale", "o_x", "o_y", "road_scale")]
    for seq, ts, x, y, ve, vn, scale, ox, oy, road in zip(*cols, strict=True):
        moving = _finite(ve, vn)
        if state is None:
            state = (Axis(x, ve if moving else 0.0, o), Axis(y, vn if moving else 0.0, o))
        else:
            dt = (ts - last) / 1000.0
            dt = 1.0 if not 0 < dt <= 10 else max(dt, 0.001)
            for axis in state:
                axis.predict(dt, o)
        last = ts
        for axis, z in zip(state, (x, y), strict=True):
            axis.place(z, o.gnss_m**2 * scale)
        if moving and o.use_velocity:
            for axis, z in zip(state, (ve, vn), strict=True):
                axis.speed(z, o.gnss_mps**2 * scale)
        if _finite(ox, oy):
            for axis, z in zip(state, (ox, oy), strict=True):
                axis.place(z, o.road_m**2 * road)
        out.append((seq, state[0].x, state[1].x, state[0].v, state[1].v))
    done = pd.DataFrame(out, columns=["seq", "x", "y", "v_e", "v_n"])
    done.insert(0, "traj_id", pdf["traj_id"].iloc[0])
    return done


def fuse(points: DataFrame, track: DataFrame, ref: tuple[float, float], o: Ekf = Ekf()) -> DataFrame:
    """Fused states of points(traj_id, seq, ts_ms, lat, lon, h, x, y, vel_*, quality_score, trusted) with track(traj_id, ts_ms, x, y, h,
    quality_score, trusted), both in the frame ref; points without a finite place are left out."""
    own = points.where(geo.is_finite("lat") & geo.is_finite("lon"))
    joined = matched(own, track, o.tolerance_ms)
    q, t = (F.col("quality_score"), F.col("trusted")) if o.use_quality_noise else (F.lit(1.0), F.lit(True))
    oq, ot = (F.col("o_quality"), F.col("o_trusted")) if o.use_quality_noise else (F.lit(1.0), F.lit(True))
    ready = joined.withColumns({"gnss_scale": quality.noise_scale(q, t, o), "road_scale": quality.noise_scale(oq, F.coalesce(ot, F.lit(True)), o)})
    road = F.col("o_x").isNotNull()
    gq = quality.safe_quality(F.col("quality_score"))
    fused = F.when(road, geo.clamp(0.6 * gq + 0.4 * quality.safe_quality(F.col("n_quality")), 0.0, 1.0)).otherwise(gq)
    rest = ready.select("traj_id", "seq", "ts_ms", "x", "y", "vel_e", "vel_n", "gnss_scale", "o_x", "o_y", "road_scale", F.when(geo.is_finite("h"), F.col("h")).otherwise(F.col("n_h")).alias("h"), F.col("vel_u").alias("v_u"), fused.alias("quality_score"), (F.col("trusted") | road).alias("_either"))
    along = ["ts_ms", "h", "v_u", "quality_score", "_either"]  # go through the fold as they are

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        return pd.concat([fold(pdf, o), pdf[along]], axis=1)

    out = rest.groupBy("traj_id").applyInPandas(run, "traj_id long, seq long, x double, y double, v_e double, v_n double, ts_ms long, h double, v_u double, quality_score double, _either boolean")
    lat0, lon0 = F.lit(ref[0]), F.lit(ref[1])
    trusted = (F.col("quality_score") >= o.trusted_quality) & F.col("_either")
    return out.select(
        "traj_id", "seq", "ts_ms", geo.to_lat(F.col("y"), lat0).alias("lat"), geo.to_lon(F.col("x"), lat0, lon0).alias("lon"), "h", "x", "y", "v_e", "v_n", "v_u", "quality_score", trusted.alias("trusted"), F.when(trusted, 0).otherwise(40).alias("trust_reason")
    )
