"""Geometry as column expressions: planar frames, distances, angles, projections. All stay inside whole-stage code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .constants import EARTH_RADIUS, GPS_EPOCH_S, LANE_OFFSETS, WEEK_S


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def is_finite(c: Column | str) -> Column:
    """Neither null nor NaN nor infinite."""
    c = col(c)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def clamp(c: Column, low: float, high: float) -> Column:
    """c within low and high; null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def gps_time_ms(week: Column | str, second: Column | str) -> Column:
    """Epoch ms of a GPS week and second of week; leap seconds are not taken off."""
    return F.round((col(week).cast("double") * WEEK_S + col(second) + GPS_EPOCH_S) * 1000.0).cast("long")


def whole_seconds(ms: Column | str) -> Column:
    """Truncated toward zero."""
    ms = col(ms)
    return (ms - ms % 1000) / 1000


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p1, p2 = F.radians(lat1), F.radians(lat2)
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def to_x(lon: Column, lat0: Column, lon0: Column) -> Column:
    return EARTH_RADIUS * F.radians(lon - lon0) * F.cos(F.radians(lat0))


def to_y(lat: Column, lat0: Column) -> Column:
    return EARTH_RADIUS * F.radians(lat - lat0)


def to_lat(y: Column, lat0: Column) -> Column:
    return lat0 + F.degrees(y / EARTH_RADIUS)


def to_lon(x: Column, lat0: Column, lon0: Column) -> Column:
    return lon0 + F.degrees(x / (EARTH_RADIUS * F.cos(F.radians(lat0))))


def angle_diff(a: Column, b: Column) -> Column:
    """Absolute difference of two headings, 0..pi."""
    d = a - b
    return F.abs(d - 2 * math.pi * F.round(d / (2 * math.pi)))


def heading_diff_both_ways(heading: Column, road: Column) -> Column:
    return F.least(angle_diff(heading, road), angle_diff(heading, road + math.pi))


def facing(road: Column, heading: Column) -> Column:
    """The road's heading or its reverse, whichever is nearer to heading; the first on a tie."""
    return F.when(angle_diff(heading, road) <= angle_diff(heading, road + math.pi), road).otherwise(road + math.pi)


def along(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column, least: float = 1e-12) -> Column:
    """Share of the way along a segment of a point's projection, held to 0..1; 0 where it is no longer than sqrt(least)."""
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    return F.when(n < least, F.lit(0.0)).otherwise(clamp(((px - x1) * dx + (py - y1) * dy) / n, 0.0, 1.0))


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def lane_point(x: Column, y: Column, heading: Column, offset: Column) -> tuple[Column, Column]:
    """A point moved to the left of a heading by offset."""
    return x - F.sin(heading) * offset, y + F.cos(heading) * offset


def lane_offset(lane: Column | str) -> Column:
    """Offset of a lane by its number, held to the lanes there are."""
    lanes = F.array(*(F.lit(x) for x in LANE_OFFSETS))
    return F.element_at(lanes, F.least(F.greatest(col(lane), F.lit(0)), F.lit(len(LANE_OFFSETS) - 1)).cast("int") + 1)


def least_endpoint_distance2(a: str, b: str) -> Column:
    """Least squared distance between the ends of two segments, columns prefixed a and b."""
    ends = [(F.col(f"{p}x{i}"), F.col(f"{p}y{i}")) for p in (a, b) for i in (1, 2)]
    return F.least(*((x[0] - y[0]) * (x[0] - y[0]) + (x[1] - y[1]) * (x[1] - y[1]) for x in ends[:2] for y in ends[2:]))
