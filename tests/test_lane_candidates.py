import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_folds import POINT, grid, track

from waymill.functions.constants import LANE_OFFSETS
from waymill.operators import lane_candidates as lc
from waymill.operators import observations, roads


def test_candidates_are_the_cheapest_lanes(spark):
    segs = grid(spark)
    points = observations.raw_speed(spark.createDataFrame(track(12), POINT))
    got = lc.lane_candidates(points, segs, "road", False).toPandas()
    pdf, table = points.orderBy("seq").toPandas(), segs.toPandas()
    w = lc.STATES["road"]
    for i, p in enumerate(pdf.itertuples()):
        want = []
        for s in table.itertuples():
            t = min(1, max(0, ((p.x - s.x1) * (s.x2 - s.x1) + (p.y - s.y1) * (s.y2 - s.y1)) / s.len**2))
            cx, cy = s.x1 + t * (s.x2 - s.x1), s.y1 + t * (s.y2 - s.y1)
            if math.hypot(cx - p.x, cy - p.y) > w[5]:
                continue
            for k, off in enumerate(LANE_OFFSETS):
                x, y = cx - off * (s.y2 - s.y1) / s.len, cy + off * (s.x2 - s.x1) / s.len
                d = math.hypot(x - p.x, y - p.y)
                if d > 50:
                    continue
                cost = w[0] * d * d
                if i:
                    b = pdf.iloc[i - 1]
                    mx, my = x - b.x, y - b.y
                    cost += w[2] * (mx * mx + my * my)
                    if mx * mx + my * my > 1:
                        a = abs(math.remainder(math.atan2(my, mx) - s.heading, math.pi))
                        cost += (1 - math.cos(a)) * w[3]
                want.append((cost, s.seg_id, k))
        own = got[got.seq == p.seq].sort_values("cand")
        want = sorted(want)[:8]
        assert own.emit_cost.tolist() == pytest.approx([c for c, _, _ in want])


def test_weights_and_predicted_step(spark):
    df = spark.createDataFrame([(r,) for r in (0.0, 8.0, 30.0)], "r double")
    got = df.select(*lc.adjusted_weights((F.lit(1.0), F.lit(1.0), F.lit(1.0)), F.col("r")), lc.predicted_step_cost(F.col("r"), F.lit(0.0))).collect()
    assert list(got[0])[:3] == [1.0, 1.0, 1.0] and list(got[2])[:3] == pytest.approx([max(0.3, 0.15 + 0.85 * 0.2), 1 + 0.8 + 0.6 * 0.8, 1 + 0.45 + 0.45 * 0.8])
    assert [r[3] for r in got] == pytest.approx([0, 8 * (0.45 + 0.35 * (1 - 0.2**2 * (3 - 0.4))) / 12, 30 * 0.45 / 12])


def test_near_node(spark):
    segs = grid(spark)
    p = spark.createDataFrame([(1, 25.0, 1.0), (1, 0.0, 45.0), (31, 200.0, 0.0)], "seg_id long, x double, y double")
    got = {(r.seg_id, r.x): r.near_node for r in lc.near_node(p, segs, roads.adjacency(segs)).collect()}
    assert got == {(1, 25.0): True, (1, 0.0): False, (31, 200.0): True}


def test_states():
    assert lc.next_state("init", 1, 0, 1, False, 0) == ("road", 0)
    assert lc.next_state("init", 30, 0, 1, True, 0) == ("init", 1)
    assert lc.next_state("road", 30, 0, 1, True, 2) == ("recovery", 3)
    assert lc.next_state("road", 1, 0, 1, True, 2) == ("node", 0)
    assert lc.next_state("node", 1, 70, 1, False, 0) == ("road", 1)
    assert lc.next_state("recovery", 1, 0, 1, False, 5) == ("road", 0)
    assert np.isfinite(lc.LaneCosts().unreachable)
