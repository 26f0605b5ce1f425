"""Fixed values of the trajectory engine, one group per stage; distances in metres, angles in radians unless named otherwise."""

from __future__ import annotations

from dataclasses import dataclass

EARTH_RADIUS = 6378137.0
GPS_EPOCH_S = 315964800.0
WEEK_S = 604800.0

# fixed values: lateral offsets of virtual lanes, positive to the left of travel
LANE_OFFSETS = (-2.4, -1.2, 0.0, 1.2, 2.4)

# fixed values: the default observation period and the periods left out of it, epoch ms, ends included
KEEP_WINDOW = (1678329750000, 1678341540000)
EXCLUDE_WINDOWS = (
    (1678330500000, 1678330620000),
    (1678331790000, 1678331850000),
    (1678333560000, 1678333680000),
    (1678340400000, 1678341000000),
)


@dataclass(frozen=True)
class SpeedDetection:
    soft_m: float = 5.0
    hard_m: float = 12.0
    floor: float = 0.15
    min_dt: float = 0.05
    max_dt: float = 10.0
    soft_sigma: float = 2.0
    hard_sigma: float = 3.0
    tolerance_ms: int = 2000
    truth_error_m: float = 5.0
    abnormal_quality: float = 0.35


@dataclass(frozen=True)
class Hmm:
    radius_m: float = 35.0
    top_k: int = 8
    sigma_m: float = 8.0
    weak_sigma_m: float = 22.0
    min_quality: float = 0.15
    weak_quality: float = 0.35
    beta_m: float = 15.0
    weak_beta_m: float = 30.0
    weak_step_m: float = 35.0
    max_step_m: float = 200.0
    gap_s: int = 5
    merge_m: float = 3.0
    unreachable: float = 1e6


@dataclass(frozen=True)
class StateMachine:
    vote_rows: int = 5
    radius_m: float = 42.0
    vote_weights: tuple[float, float] = (0.7, 0.3)  # distance, heading
    turn_weights: tuple[float, float, float] = (0.2, 0.2, 0.6)  # distance, heading, overshoot
    leave_deg: float = 60.0
    leave_m: float = 42.0
    static_mps: float = 0.35
    buffer_m: float = 5.0
    fuse: tuple[float, float] = (0.8, 0.2)  # dead reckoning, projection
    hold_m: float = 6.0
    gap_s: int = 5
    adjacent_m: float = 8.0
    touch_m: float = 12.0
    keep_heading_deg: float = 135.0
    cluster_deg: float = 30.0
    cluster_m: float = 25.0


@dataclass(frozen=True)
class SpeedAssist:
    """Speed detection inside the state-machine matcher."""

    floor: float = 0.08
    warm_up: int = 8
    min_sigma_m: float = 1.0
    soft_m: float = 5.0
    hard_m: float = 12.0
    extreme_m: float = 20.0
    center_blend: float = 0.30
    stop_blend: float = 0.85
    smooth: float = 0.7


@dataclass(frozen=True)
class Ekf:
    start_m: float = 8.0
    start_mps: float = 3.0
    process_m: float = 0.8
    process_mps: float = 0.6
    gnss_m: float = 6.0
    gnss_mps: float = 1.5
    road_m: float = 0.5
    min_quality: float = 0.2
    untrusted_scale: float = 4.0
    tolerance_ms: int = 1000
    trusted_quality: float = 0.35
    use_velocity: bool = True
    use_quality_noise: bool = True
