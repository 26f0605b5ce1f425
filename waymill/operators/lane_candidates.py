"""Weighted lane candidates and their transitions: the costs of an alternative matcher over lanes, as relations.

Candidates are lanes of near segments with a cost per epoch; transitions compare the way along roads with what was observed and predicted; the
least path comes from hmm.viterbi. The state (init, road, node, recovery) sets weights and radius.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, quality
from ..functions.constants import LANE_OFFSETS
from .observations import ordered
from .roads import grid_join

# fixed values: weights of a state's terms (observation, dead reckoning, continuity, direction of travel, direction of velocity) and its radius
STATES = {
    "init": (1.0, 0.10, 0.04, 18.0, 10.0, 60.0),
    "road": (1.0, 0.35, 0.12, 40.0, 18.0, 70.0),
    "node": (0.85, 0.12, 0.10, 28.0, 55.0, 85.0),
    "recovery": (1.0, 0.10, 0.04, 18.0, 10.0, 60.0),
}


@dataclass(frozen=True)
class LaneCosts:
    snap_m: float = 50.0
    still_radius_m: float = 18.0
    node_m: float = 30.0
    top_k: int = 8
    route_beta: float = 15.0
    predicted_beta: float = 12.0
    lane_weight: float = 0.40
    not_adjacent: float = 15.0
    other_cluster: float = 8.0
    backward: float = 10.0
    unreachable: float = 1e9
    bad_obs_m: float = 22.0
    bad_turn_deg: float = 65.0
    bad_cost: float = 900.0
    bad_limit: int = 3
    base_gain: float = 0.45
    residual_gain: float = 0.35
    soft_floor: float = 0.20


def adjusted_weights(w: tuple[Column, Column, Column], residual: Column, soft: float = 5.0, hard: float = 12.0, extreme: float = 20.0, o: LaneCosts = LaneCosts()) -> tuple[Column, Column, Column]:
    """Observation weight down, dead reckoning and continuity up, as the residual grows."""
    q, grade = quality.smooth_quality(residual, soft, hard, o.soft_floor), quality.severity(residual, soft, extreme)
    return w[0] * F.greatest(F.lit(0.30), 0.15 + 0.85 * q), w[1] * (1.0 + 0.80 * grade + 0.60 * (1.0 - q)), w[2] * (1.0 + 0.45 * grade + 0.45 * (1.0 - q))


def velocity_heading_cost(e: Column, n: Column, road: Column, weight: float, still: Column) -> Column:
    """0 where standing still or below 0.8 m/s."""
    return F.when(still | (F.sqrt(e * e + n * n) < 0.80) | e.isNull(), 0.0).otherwise((1.0 - F.cos(geo.heading_diff_both_ways(F.atan2(n, e), road))) * weight)


def predicted_step_cost(route: Column, step: Column, o: LaneCosts = LaneCosts()) -> Column:
    residual = F.abs(route - step)
    return (o.base_gain + o.residual_gain * (1.0 - quality.severity(residual, 5.0, 20.0))) * residual / o.predicted_beta


def near_node(points: DataFrame, segs: DataFrame, adjacent: DataFrame, o: LaneCosts = LaneCosts()) -> DataFrame:
    """points(seg_id, x, y, ...) with near_node: an end of its segment lies within node_m, and the segment has neighbours."""
    beside = adjacent.select("seg_id").distinct().withColumn("_beside", F.lit(True))
    ends = segs.select("seg_id", "x1", "y1", "x2", "y2")
    d = F.least(geo.distance(F.col("x"), F.col("y"), F.col("x1"), F.col("y1")), geo.distance(F.col("x"), F.col("y"), F.col("x2"), F.col("y2")))
    return points.join(ends, "seg_id").join(beside, "seg_id", "left").withColumn("near_node", (d <= o.node_m) & F.coalesce("_beside", F.lit(False))).drop("x1", "y1", "x2", "y2", "_beside")


def lane_candidates(points: DataFrame, segs: DataFrame, state: str = "road", speed_detection: bool = True, o: LaneCosts = LaneCosts()) -> DataFrame:
    """The top_k cheapest lanes of each point(traj_id, seq, ts_ms, x, y, speed_e, speed_n): cand, seg_id, lane, lx, ly, s, d_obs, emit_cost.
    Dead reckoning is from the raw point before by its speed."""
    w = STATES[state]
    prev = {c: F.lag(c).over(ordered()) for c in ("x", "y", "speed_e", "speed_n", "ts_ms")}
    dt = (F.col("ts_ms") - prev["ts_ms"]) / 1000.0
    own = points.withColumns({"px0": prev["x"], "py0": prev["y"], "dr_x": F.coalesce(prev["x"] + prev["speed_e"] * dt, "x"), "dr_y": F.coalesce(prev["y"] + prev["speed_n"] * dt, "y")})
    near = grid_join(own.select("traj_id", "seq", "x", "y", "px0", "py0", "dr_x", "dr_y", "speed_e", "speed_n"), segs.where("len >= 1e-8"), w[5])
    lanes = near.withColumn("_l", F.explode(F.array(*(F.struct(F.lit(i).alias("lane"), F.lit(k).alias("off")) for i, k in enumerate(LANE_OFFSETS)))))
    lx, ly = geo.lane_point(F.col("px"), F.col("py"), F.col("heading"), F.col("_l.off"))
    lanes = lanes.withColumns({"lx": lx, "ly": ly, "lane": F.col("_l.lane"), "lane_offset": F.col("_l.off")})
    lanes = lanes.withColumn("d_obs", geo.distance(F.col("lx"), F.col("ly"), F.col("x"), F.col("y"))).where(F.col("d_obs") <= o.snap_m)
    residual = geo.distance(F.col("x"), F.col("y"), F.col("dr_x"), F.col("dr_y"))
    weights = tuple(F.lit(v) for v in w[:3])
    if speed_detection:
        weights = adjusted_weights(weights, residual, o=o)
    else:
        weights = (weights[0], F.lit(0.0), weights[2])
    mx, my = F.col("lx") - F.col("px0"), F.col("ly") - F.col("py0")
    turn = F.when(mx * mx + my * my > 1.0, geo.heading_diff_both_ways(F.atan2(my, mx), F.col("heading"))).otherwise(0.0)
    still = F.coalesce(F.sqrt(F.col("speed_e") * F.col("speed_e") + F.col("speed_n") * F.col("speed_n")) <= 0.35, F.lit(False))
    cost = (
        weights[0] * F.col("d_obs") * F.col("d_obs")
        + weights[1] * F.pow(geo.distance(F.col("lx"), F.col("ly"), F.col("dr_x"), F.col("dr_y")), F.lit(2.0))
        + weights[2] * F.coalesce(mx * mx + my * my, F.lit(0.0))
        + F.when(still, 0.0).otherwise((1.0 - F.cos(F.coalesce(turn, F.lit(0.0)))) * w[3])
    )
    if speed_detection:
        cost = cost + velocity_heading_cost(F.col("speed_e"), F.col("speed_n"), F.col("heading"), w[4], still)
    best = Window.partitionBy("traj_id", "seq").orderBy("emit_cost", "seg_id", "lane")
    out = lanes.withColumns({"emit_cost": cost, "dir_diff": F.coalesce(turn, F.lit(0.0))}).withColumn("cand", F.row_number().over(best) - 1).where(F.col("cand") < o.top_k)
    return out.select("traj_id", "seq", "cand", "seg_id", "lane", "lane_offset", "lx", "ly", "s", "d_obs", "dir_diff", "emit_cost")


def transition_costs(routes: DataFrame, adjacent: DataFrame, clusters: DataFrame, predicted: Column, o: LaneCosts = LaneCosts()) -> DataFrame:
    """routes (pairs of hmm.route_distances, with step, lane_offset and p_lane_offset) with trans_cost."""
    link = adjacent.select(F.col("seg_id").alias("p_seg_id"), F.col("other").alias("seg_id"), F.lit(True).alias("_linked"))
    own, before = clusters.select("seg_id", F.col("cluster").alias("_c")), clusters.select(F.col("seg_id").alias("p_seg_id"), F.col("cluster").alias("_pc"))
    j = routes.join(link, ["p_seg_id", "seg_id"], "left").join(own, "seg_id", "left").join(before, "p_seg_id", "left")
    same = F.col("seg_id") == F.col("p_seg_id")
    back = F.when((predicted > 1.5) & (F.col("s") + 2.0 < F.col("p_s")), o.backward).otherwise(0.0)
    away = F.when(F.col("_linked").isNull(), o.not_adjacent).otherwise(0.0) + F.when(F.col("_c") != F.col("_pc"), o.other_cluster).otherwise(0.0)
    cost = F.abs(F.col("route") - F.col("step")) / o.route_beta + predicted_step_cost(F.col("route"), predicted, o) + o.lane_weight * F.abs(F.col("lane_offset") - F.col("p_lane_offset")) + F.when(same, back).otherwise(away)
    return j.withColumn("trans_cost", F.when(F.col("route").isNull(), o.unreachable).otherwise(cost)).drop("_linked", "_c", "_pc")


def next_state(state: str, d_obs: float, turn_deg: float, cost: float, at_node: bool, bad: int, o: LaneCosts = LaneCosts()) -> tuple[str, int]:
    """The state after an epoch, and the run of bad epochs."""
    wrong = d_obs > o.bad_obs_m or turn_deg > o.bad_turn_deg or cost > o.bad_cost
    bad = bad + 1 if wrong else 0
    place = "node" if at_node else "road"
    if state in ("init", "recovery"):
        return (state if wrong else place), bad
    return ("recovery" if bad >= o.bad_limit else place), bad
