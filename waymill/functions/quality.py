"""Quality, noise and cost terms as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import Ekf, Hmm, SpeedDetection
from .geo import clamp, is_finite

SD = SpeedDetection()
HMM = Hmm()
EKF = Ekf()


def smoothstep(x: Column) -> Column:
    x = clamp(x, 0.0, 1.0)
    return x * x * (3.0 - 2.0 * x)


def ramp(residual: Column, soft: Column | float, hard: Column | float, floor: float = SD.floor) -> Column:
    """1 up to soft, then straight down to floor at hard."""
    soft, hard = (F.lit(v) if isinstance(v, float) else v for v in (soft, hard))
    return F.when(residual <= soft, 1.0).when(residual >= hard, floor).otherwise(1.0 - (1.0 - floor) * (residual - soft) / (hard - soft))


def smooth_quality(residual: Column, soft: float, hard: float, floor: float) -> Column:
    return 1.0 - (1.0 - floor) * smoothstep((residual - soft) / (hard - soft))


def severity(residual: Column, soft: float, extreme: float) -> Column:
    return smoothstep((residual - soft) / (extreme - soft))


def safe_quality(q: Column) -> Column:
    return F.when(is_finite(q), clamp(q, 0.0, 1.0)).otherwise(1.0)


def noise_scale(q: Column, trusted: Column, o: Ekf = EKF) -> Column:
    held = clamp(F.when(is_finite(q), q).otherwise(1.0), o.min_quality, 1.0)
    return 1.0 / (held * held) * F.when(trusted, 1.0).otherwise(o.untrusted_scale)


def distance_index(d: Column) -> Column:
    return clamp(1.064 * F.exp(-F.pow((d + 8.703) / 35.37, F.lit(2.0))), 0.0, 1.0)


def heading_index(radians: Column) -> Column:
    return clamp(7.973 * F.exp(-F.pow((F.degrees(radians) + 204.4) / 141.8, F.lit(2.0))), 0.0, 1.0)


def hmm_quality(q: Column, speed_detection: bool, o: Hmm = HMM) -> Column:
    return clamp(F.when(is_finite(q), q).otherwise(1.0), o.min_quality, 1.0) if speed_detection else F.lit(1.0)


def weak(trusted: Column, q: Column, speed_detection: bool, o: Hmm = HMM) -> Column:
    return ~trusted | (q < o.weak_quality) if speed_detection else F.lit(False)


def emission_sigma(q: Column, is_weak: Column, o: Hmm = HMM) -> Column:
    return F.when(is_weak, o.weak_sigma_m).otherwise(o.sigma_m) / F.sqrt(q)


def emission_cost(d: Column, sigma: Column) -> Column:
    return 0.5 * (d / sigma) * (d / sigma)


def _bounded(e: Column, n: Column, low: float, high: float) -> Column:
    v = F.sqrt(e * e + n * n)
    return is_finite(e) & is_finite(n) & (v >= low) & (v <= high)


def valid_speed(low: float = 0.05) -> tuple[Column, Column]:
    """East and north speed: phase velocity where plausible, else Doppler velocity under `low` as its least, else null."""
    pe, pn, de, dn = (F.col(c) for c in ("pha_e", "pha_n", "vel_e", "vel_n"))
    phase, doppler = _bounded(pe, pn, 0.05, 60.0), _bounded(de, dn, low, 60.0)
    return F.when(phase, pe).when(doppler, de), F.when(phase, pn).when(doppler, dn)
