"""State-machine map matching: a road is voted for, followed by dead reckoning, and left at nodes or on contradiction.

The fold carries what it knew of the epoch before, so a trajectory is one group; trajectories are independent. Roads and their adjacency go
to the executors whole, as long as their checked size allows it.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.constants import LANE_OFFSETS, SpeedAssist, StateMachine
from .roads import adjacency, checked

CENTER, COST, TRANS, HEADING = 1, 2, 4, 8
PI = math.pi


def angle(a: float, b: float) -> float:
    d = (a - b) % (2 * PI)
    return min(d, 2 * PI - d)


def both_ways(a: float, road: float) -> float:
    return min(angle(a, road), angle(a, road + PI))


def distance_index(d: float) -> float:
    return min(1.0, max(0.0, 1.064 * math.exp(-(((d + 8.703) / 35.37) ** 2))))


def heading_index(r: float) -> float:
    return min(1.0, max(0.0, 7.973 * math.exp(-(((math.degrees(r) + 204.4) / 141.8) ** 2))))


def smooth(x: float) -> float:
    x = min(1.0, max(0.0, x))
    return x * x * (3 - 2 * x)


@dataclass
class On:
    """A place on a lane of a segment."""

    seg: int
    x: float
    y: float
    lane: float
    dist: float


class Roads:
    """Segments by row number, in the order of their ids, under a grid for radius searches."""

    def __init__(self, table: pd.DataFrame, pairs: pd.DataFrame, lanes: bool = True, cell: float = 100.0) -> None:
        table = table.sort_values("seg_id")
        self.ids = table["seg_id"].to_numpy(np.int64)
        self.x1, self.y1, self.x2, self.y2, self.heading = (table[c].to_numpy(float) for c in ("x1", "y1", "x2", "y2", "heading"))
        self.dx, self.dy = self.x2 - self.x1, self.y2 - self.y1
        self.n2 = self.dx**2 + self.dy**2
        self.offsets = np.array(LANE_OFFSETS if lanes else (0.0,))
        self.lanes, self.cell = lanes, cell
        at = {int(s): i for i, s in enumerate(self.ids)}
        self.beside: dict[int, list[int]] = defaultdict(list)
        for a, b in zip(pairs["seg_id"], pairs["other"], strict=True):
            self.beside[at[int(a)]].append(at[int(b)])
        self.cells: dict[tuple[int, int], list[int]] = defaultdict(list)
        for i in range(len(self.ids)):
            xs, ys = sorted((self.x1[i], self.x2[i])), sorted((self.y1[i], self.y2[i]))
            for cx in range(math.floor(xs[0] / cell), math.floor(xs[1] / cell) + 1):
                for cy in range(math.floor(ys[0] / cell), math.floor(ys[1] / cell) + 1):
                    self.cells[cx, cy].append(i)

    def project(self, i: np.ndarray | int, x: float, y: float) -> tuple:
        t = np.clip(((x - self.x1[i]) * self.dx[i] + (y - self.y1[i]) * self.dy[i]) / np.maximum(self.n2[i], 1e-300), 0, 1)
        return self.x1[i] + t * self.dx[i], self.y1[i] + t * self.dy[i]

    def near(self, x: float, y: float, radius: float) -> np.ndarray:
        span = range(math.floor((x - radius) / self.cell), math.floor((x + radius) / self.cell) + 1)
        rows = range(math.floor((y - radius) / self.cell), math.floor((y + radius) / self.cell) + 1)
        i = np.array(sorted({s for cx in span for cy in rows for s in self.cells.get((cx, cy), ())}), int)
        i = i[self.n2[i] >= 1e-8]
        px, py = self.project(i, x, y)
        return i[(px - x) ** 2 + (py - y) ** 2 <= radius * radius]

    def lane(self, i: int, x: float, y: float, offset: float) -> On | None:
        if self.n2[i] < 1e-8:
            return None
        px, py = self.project(i, x, y)
        n = math.sqrt(self.n2[i])
        lx, ly = px - offset * self.dy[i] / n, py + offset * self.dx[i] / n
        return On(i, float(lx), float(ly), offset, math.hypot(lx - x, ly - y))

    def best_lane(self, i: int, x: float, y: float) -> On | None:
        found = [p for p in (self.lane(i, x, y, float(k)) for k in self.offsets) if p]
        return min(found, key=lambda p: p.dist) if found else None

    def lane_distances(self, i: np.ndarray, x: float, y: float) -> np.ndarray:
        px, py = self.project(i, x, y)
        n = np.sqrt(self.n2[i])[:, None]
        k = self.offsets[None, :]
        return np.hypot(px[:, None] - k * self.dy[i, None] / n - x, py[:, None] + k * self.dx[i, None] / n - y).min(1)

    def facing(self, i: int, heading: float | None) -> float:
        h = float(self.heading[i])
        return h if heading is None or angle(heading, h) <= angle(heading, h + PI) else h + PI


@dataclass
class Assist:
    """The speed-detection side of the fold: residual statistics and smoothed speed."""

    mode: int
    o: SpeedAssist = field(default_factory=SpeedAssist)
    n: int = 0
    mean: float = 0.0
    m2: float = 0.0
    v: tuple[float, float] | None = None

    def limits(self) -> tuple[float, float, float, bool]:
        if self.n < self.o.warm_up:
            return self.o.soft_m, self.o.hard_m, self.o.extreme_m, False
        s = max(math.sqrt(max(self.m2 / (self.n - 1), 0.0)), self.o.min_sigma_m)
        return self.mean + 2 * s, self.mean + 3 * s, self.mean + 4 * s, True

    def learn(self, r: float) -> None:
        self.n += 1
        d = r - self.mean
        self.mean += d / self.n
        self.m2 += d * (r - self.mean)

    def epoch(self, x: float, y: float, prev: tuple[float, float] | None, speed: tuple[float, float] | None, dt: float) -> tuple[float, float, bool, int, float, bool]:
        """Centre x, y, trusted, reason, quality, whether it stands still."""
        if prev is None:
            self.n, self.mean, self.m2 = 0, 0.0, 0.0
            return x, y, True, 0, 1.0, False
        still = speed is not None and math.hypot(*speed) <= 0.35
        if still:
            v = (0.0, 0.0)
        elif speed is not None:
            v = speed if self.v is None else (0.65 * speed[0] + 0.35 * self.v[0], 0.65 * speed[1] + 0.35 * self.v[1])
        else:
            v = self.v or (0.0, 0.0)
        px, py = prev[0] + v[0] * dt, prev[1] + v[1] * dt
        r = math.hypot(x - px, y - py)
        soft, hard, extreme, sigma = self.limits()
        out = (x, y, True, 0, 1.0, still)
        if self.mode & CENTER:
            q = 1.0 if r <= soft else self.o.floor if r >= hard else 1 - smooth((r - soft) / max(hard - soft, 1e-6)) * (1 - self.o.floor)
            if still:
                a = self.o.stop_blend
                out = ((1 - a) * x + a * prev[0], (1 - a) * y + a * prev[1], True, 6, q, True)
            else:
                grade = 0.0 if r <= soft else 1.0 if r >= extreme else smooth((r - soft) / max(extreme - soft, 1e-6))
                a = self.o.center_blend * grade
                step = (r > soft) + (r > hard) + (r > extreme)
                out = ((1 - a) * x + a * px, (1 - a) * y + a * py, step < 3, step + 10 * sigma, (1.0, q, q, self.o.floor)[step], False)
        if r <= extreme:
            self.learn(r)
        return out

    def moved(self, speed: tuple[float, float] | None, place: tuple[float, float], prev: tuple[float, float] | None, dt: float) -> None:
        a = self.o.smooth
        if speed is not None:
            self.v = speed if self.v is None else (a * speed[0] + (1 - a) * self.v[0], a * speed[1] + (1 - a) * self.v[1])
        elif prev is not None:
            self.v = ((place[0] - prev[0]) / max(dt, 0.2), (place[1] - prev[1]) / max(dt, 0.2))


def _speed(row: tuple, low: float) -> tuple[float, float] | None:
    pe, pn, de, dn = row
    for e, n, least in ((pe, pn, 0.05), (de, dn, low)):
        if e is not None and n is not None and math.isfinite(e) and math.isfinite(n) and least <= math.hypot(e, n) <= 60.0:
            return e, n
    return None


class Matcher:
    """One trajectory's fold. Rows are given whole, as a vote looks at the rows after."""

    def __init__(self, roads: Roads, pdf: pd.DataFrame, speed_detection: bool, mode: int, o: StateMachine = StateMachine()) -> None:
        self.roads, self.o = roads, o
        self.x, self.y = pdf["x"].tolist(), pdf["y"].tolist()
        self.sec = [int(math.trunc(t / 1000)) for t in pdf["ts_ms"]]
        v = list(zip(*(pdf[c].tolist() for c in ("pha_e", "pha_n", "vel_e", "vel_n")), strict=True))
        self.raw, self.valid = [_speed(r, 0.0) for r in v], [_speed(r, 0.05) for r in v]
        self.assist = Assist(mode) if speed_detection and mode else None

    def observed_heading(self, i: int) -> float | None:
        a, b = (i - 1, i) if i else (0, 1)
        if b >= len(self.x):
            return None
        dx, dy = self.x[b] - self.x[a], self.y[b] - self.y[a]
        return math.atan2(dy, dx) if dx * dx + dy * dy > 1.0 else None

    def moving_heading(self, i: int) -> float | None:
        v = self.raw[i]
        return math.atan2(v[1], v[0]) if v and math.hypot(*v) > self.o.static_mps else None

    def vote(self, i: int) -> int | None:
        """The segment of the best mean score over the rows from i on; the lowest id wins ties."""
        rows = range(i, min(len(self.x), i + self.o.vote_rows))
        near = sorted({int(s) for k in rows for s in self.roads.near(self.x[k], self.y[k], self.o.radius_m)})
        if not near:
            every = np.flatnonzero(self.roads.n2 >= 1e-8)
            if not len(every):
                return None
            near = [int(every[self.roads.lane_distances(every, self.x[i], self.y[i]).argmin()])]
        segs = np.array(near)
        total = np.zeros(len(segs))
        for k in rows:
            heading = self.moving_heading(k)
            heading = self.observed_heading(k) if heading is None else heading
            d = self.roads.lane_distances(segs, self.x[k], self.y[k])
            for n, s in enumerate(near):
                h = 0.0 if heading is None else both_ways(heading, float(self.roads.heading[s]))
                total[n] += self.o.vote_weights[0] * distance_index(float(d[n])) + self.o.vote_weights[1] * heading_index(h)
        return near[int((total / len(rows)).argmax())]

    def ahead(self, seg: int, x: float, y: float, heading: float) -> tuple[float, float, float] | None:
        """The nearer end that isn't behind, and its distance, of a segment with neighbours."""
        if not self.roads.beside.get(seg):
            return None
        found = []
        for ex, ey in ((self.roads.x1[seg], self.roads.y1[seg]), (self.roads.x2[seg], self.roads.y2[seg])):
            dx, dy = float(ex) - x, float(ey) - y
            if dx * math.cos(heading) + dy * math.sin(heading) >= -2.0:
                found.append((math.hypot(dx, dy), float(ex), float(ey)))
        if not found:
            return None
        d, ex, ey = min(found, key=lambda f: f[0])
        return ex, ey, d

    def fused(self, on: On, px: float, py: float) -> On | None:
        a, b = self.o.fuse
        return self.roads.lane(on.seg, a * px + b * on.x, a * py + b * on.y, on.lane)

    def turn(self, seg: int, node: tuple[float, float], over: float, x: float, y: float, heading: float | None) -> On | None:
        """The best of the neighbours that touch the node, the lowest id on a tie."""
        r, best, top = self.roads, None, -1.0
        touch = sorted({s for s in r.beside.get(seg, ()) if min(math.hypot(r.x1[s] - node[0], r.y1[s] - node[1]), math.hypot(r.x2[s] - node[0], r.y2[s] - node[1])) <= self.o.touch_m})
        for s in touch or [seg]:
            first = math.hypot(node[0] - r.x1[s], node[1] - r.y1[s]) <= math.hypot(node[0] - r.x2[s], node[1] - r.y2[s])
            away = float(r.heading[s]) + (0.0 if first else PI)
            on = r.best_lane(s, x, y)
            place = on and self.fused(on, node[0] + over * math.cos(away), node[1] + over * math.sin(away))
            if not place:
                continue
            h = 0.0 if heading is None else both_ways(heading, away)
            w = self.o.turn_weights
            score = w[0] * distance_index(on.dist) + w[1] * heading_index(h) + w[2]
            if best is None or score > top:
                best, top = place, score
        return best

    def run(self) -> Iterator[tuple]:
        """seg_id (None: unmatched), x, y, trusted, reason, quality of each row."""
        o, r = self.o, self.roads
        on: On | None = None
        road = 0.0
        seen: tuple[float, float] | None = None
        for i, (x, y) in enumerate(zip(self.x, self.y, strict=True)):
            dt = 1.0
            if i:
                gap = self.sec[i] - self.sec[i - 1]
                dt = float(gap) if 0.05 < gap < 10 else 1.0
                if gap > o.gap_s:
                    on = None
                    if self.assist:
                        self.assist.v = None
            moved = math.hypot(x - seen[0], y - seen[1]) if seen else 0.0
            seen = (x, y)
            prev = (on.x, on.y) if on else None
            speed = self.valid[i] if self.assist else None
            cx, cy, trusted, reason, q, still = self.assist.epoch(x, y, prev, speed, dt) if self.assist else (x, y, True, 0, 1.0, False)

            raw = self.raw[i]
            if speed and math.hypot(*speed) > o.static_mps:
                rate, heading = math.hypot(*speed), math.atan2(speed[1], speed[0])
            else:
                rate, heading = math.hypot(*raw) if raw else 0.0, self.moving_heading(i)
            if heading is None:
                heading = self.observed_heading(i)
            if rate <= o.static_mps:
                rate = moved / dt
            step = rate * dt if rate > o.static_mps else moved
            if self.assist and self.assist.mode & TRANS and speed:
                step = math.hypot(*speed) * max(dt, 0.2)
            known = speed or raw
            still = still or bool(on and known and math.hypot(*known) <= o.static_mps and moved <= o.hold_m)

            place = None
            if still and on:
                place = r.lane(on.seg, on.x, on.y, on.lane)
            if place is None and on is None:
                voted = self.vote(i)
                place = r.best_lane(voted, cx, cy) if voted is not None else None
            elif place is None:
                node = self.ahead(on.seg, on.x, on.y, road)
                if node and step + o.buffer_m >= node[2]:
                    place = self.turn(on.seg, node[:2], max(0.0, step - node[2]), cx, cy, heading)
                if place is None:
                    way = r.facing(on.seg, heading)
                    way = road if angle(road, way) < math.radians(o.keep_heading_deg) else way
                    lane = r.lane(on.seg, cx, cy, on.lane)
                    place = lane and self.fused(lane, on.x + step * math.cos(way), on.y + step * math.sin(way))
            if place is None:
                on = None
                if self.assist:
                    self.assist.v = None
                yield None, x, y, trusted, reason, q
                continue

            way = r.facing(place.seg, heading)
            if on and place.seg == on.seg and angle(road, way) < math.radians(o.keep_heading_deg):
                way = road
            off = heading is not None and both_ways(heading, way) > math.radians(o.leave_deg)
            if not still and (off or math.hypot(place.x - cx, place.y - cy) > o.leave_m):
                voted = self.vote(i)
                again = r.best_lane(voted, cx, cy) if voted is not None else None
                if again:
                    place, way = again, r.facing(again.seg, heading)
            if self.assist:
                self.assist.moved(speed, (place.x, place.y), prev, dt)
            on, road = place, way
            yield int(r.ids[place.seg]), place.x, place.y, trusted, reason, q


def match(points: DataFrame, segs: DataFrame, speed_detection: bool = False, mode: int = CENTER | TRANS, lanes: bool = True, o: StateMachine = StateMachine()) -> DataFrame:
    """traj_id, seq, ts_ms, seg_id (null: unmatched, raw place), mx, my, trusted, trust_reason, quality_score for points in the segments' frame."""
    spark = points.sparkSession
    roads = spark.sparkContext.broadcast(Roads(checked(segs), checked(adjacency(segs, o.adjacent_m)), lanes))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq").reset_index(drop=True)
        clean = pdf.astype(object).where(pdf.notna(), None)
        got = pd.DataFrame(list(Matcher(roads.value, clean, speed_detection, mode, o).run()), columns=["seg_id", "mx", "my", "trusted", "trust_reason", "quality_score"])
        got["seg_id"] = got["seg_id"].astype("Int64")
        return pd.concat([pdf[["traj_id", "seq", "ts_ms"]], got], axis=1)

    own = points.select("traj_id", "seq", "ts_ms", "x", "y", "pha_e", "pha_n", "vel_e", "vel_n")
    return own.groupBy("traj_id").applyInPandas(run, "traj_id long, seq long, ts_ms long, seg_id long, mx double, my double, trusted boolean, trust_reason int, quality_score double")


def segment_votes(points: DataFrame, segs: DataFrame, o: StateMachine = StateMachine()) -> DataFrame:
    """traj_id, seq, seg_id, score: the vote at every row, relationally: the rows after it by a window, near segments by grid_join, scores by
    projection; rows with no segment in reach have none here."""
    from pyspark.sql import Window

    from ..functions import quality
    from .observations import observation_heading, ordered, raw_speed
    from .roads import grid_join

    w = ordered().rowsBetween(0, o.vote_rows - 1)
    head = observation_heading(raw_speed(points)).withColumn("heading", F.coalesce("speed_heading", "obs_heading"))
    ahead = head.withColumn("frame", F.collect_list(F.struct("seq", "x", "y", "heading")).over(w)).select("traj_id", F.col("seq").alias("at"), F.explode("frame").alias("r"), F.size("frame").alias("n"))
    flat = ahead.select("traj_id", "at", "n", "r.seq", "r.x", "r.y", "r.heading")
    near = grid_join(points.select("traj_id", "seq", "x", "y"), segs.where("len * len >= 1e-8"), o.radius_m).select("traj_id", "seq", "seg_id")
    asked = flat.select("traj_id", "at", "seq").join(near, ["traj_id", "seq"]).select("traj_id", "at", "seg_id").distinct()
    road = segs.select("seg_id", "x1", "y1", "x2", "y2", F.col("heading").alias("road"))
    each = flat.join(asked, ["traj_id", "at"]).join(road, "seg_id")
    t = geo.along(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    each = each.withColumn("t", t).withColumns({"px": F.col("x1") + F.col("t") * (F.col("x2") - F.col("x1")), "py": F.col("y1") + F.col("t") * (F.col("y2") - F.col("y1"))})
    lanes = F.array(*(geo.distance(F.col("x"), F.col("y"), *geo.lane_point(F.col("px"), F.col("py"), F.col("road"), F.lit(k))) for k in LANE_OFFSETS))
    turn = F.when(F.col("heading").isNull(), 0.0).otherwise(geo.heading_diff_both_ways(F.col("heading"), F.col("road")))
    score = o.vote_weights[0] * quality.distance_index(F.array_min(lanes)) + o.vote_weights[1] * quality.heading_index(turn)
    mean = each.groupBy("traj_id", "at", "seg_id").agg((F.sum(score) / F.max("n")).alias("score"))
    best = Window.partitionBy("traj_id", "at").orderBy(F.col("score").desc(), "seg_id")
    return mean.withColumn("_r", F.row_number().over(best)).where("_r = 1").select("traj_id", F.col("at").alias("seq"), "seg_id", "score")
