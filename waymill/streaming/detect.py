"""Speed prediction and Kalman fusion over streams of observations.

Both are causal. The state is one row per trajectory (prediction) or two small filters (fusion), so memory doesn't grow with the stream. Rows of
a trajectory are taken in the order of their time within each micro-batch; rows older than the last one seen are passed through unscored,
as the batch operators would have scored them against another predecessor. A fixed frame takes the place of the batch's centroid.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.constants import Ekf, SpeedDetection
from ..operators.ekf import Axis

SCORED = "traj_id long, seq long, ts_ms long, x double, y double, residual_m double, trusted boolean, trust_reason int, quality_score double"
FUSED = "traj_id long, seq long, ts_ms long, x double, y double, v_e double, v_n double"


def _sorted(batches: Iterator[pd.DataFrame]) -> pd.DataFrame:
    return pd.concat(list(batches)).sort_values(["ts_ms", "seq"], kind="stable")


def prediction(points: DataFrame, o: SpeedDetection = SpeedDetection()) -> DataFrame:
    """SCORED for a stream of points(traj_id, seq, ts_ms, x, y, v_e, v_n)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        out = []
        for r in _sorted(batches).itertuples():
            residual = None
            if last is not None:
                dt = (r.ts_ms - last[0]) / 1000.0
                if o.min_dt < dt <= o.max_dt and None not in (last[1], last[2], last[3], last[4]) and not pd.isna([r.x, r.y, *last[1:]]).any():
                    residual = ((r.x - last[1] - last[3] * dt) ** 2 + (r.y - last[2] - last[4] * dt) ** 2) ** 0.5
            bad = residual is not None and residual > o.hard_m
            q = 1.0 if residual is None or residual <= o.soft_m else max(o.floor, 1 - (1 - o.floor) * (residual - o.soft_m) / (o.hard_m - o.soft_m))
            out.append((r.traj_id, r.seq, r.ts_ms, r.x, r.y, residual, not bad, 20 if bad else 0, q))
            if last is None or r.ts_ms >= last[0]:
                last = (int(r.ts_ms), float(r.x), float(r.y), float(r.v_e), float(r.v_n))
        state.update(last)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in SCORED.split(", ")])

    own = points.select("traj_id", "seq", "ts_ms", "x", "y", "v_e", "v_n")
    return own.groupBy("traj_id").applyInPandasWithState(run, SCORED, "ts_ms long, x double, y double, v_e double, v_n double", "append", GroupStateTimeout.NoTimeout)


def fusion(points: DataFrame, o: Ekf = Ekf()) -> DataFrame:
    """FUSED for a stream of points(traj_id, seq, ts_ms, x, y, vel_e, vel_n, gnss_scale)."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        axes = None
        if held:
            axes = (Axis(0, 0, o), Axis(0, 0, o))
            for axis, v in zip(axes, (held[1:6], held[6:11]), strict=True):
                axis.x, axis.v, axis.a, axis.b, axis.c = v
        last, out = held[0] if held else None, []
        for r in _sorted(batches).itertuples():
            if axes is None:
                axes = (Axis(r.x, r.vel_e, o), Axis(r.y, r.vel_n, o))
            else:
                dt = (r.ts_ms - last) / 1000.0
                for axis in axes:
                    axis.predict(1.0 if not 0 < dt <= 10 else max(dt, 0.001), o)
            last = int(r.ts_ms)
            for axis, place, speed in zip(axes, (r.x, r.y), (r.vel_e, r.vel_n), strict=True):
                axis.place(place, o.gnss_m**2 * r.gnss_scale)
                axis.speed(speed, o.gnss_mps**2 * r.gnss_scale)
            out.append((r.traj_id, r.seq, r.ts_ms, axes[0].x, axes[1].x, axes[0].v, axes[1].v))
        state.update((last, *(float(v) for axis in axes for v in (axis.x, axis.v, axis.a, axis.b, axis.c))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FUSED.split(", ")])

    parts = ", ".join(f"{a}{n} double" for n in "01" for a in ("x", "v", "a", "b", "c"))
    own = points.select("traj_id", "seq", "ts_ms", "x", "y", "vel_e", "vel_n", "gnss_scale")
    return own.groupBy("traj_id").applyInPandasWithState(run, FUSED, f"ts_ms long, {parts}", "append", GroupStateTimeout.NoTimeout)
