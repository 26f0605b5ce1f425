"""The sequential operators against plain versions of their own, and edge cases of each."""

import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from waymill.functions import geo, quality
from waymill.functions.constants import Ekf, Hmm
from waymill.operators import asof, ekf, hmm, observations, roads, speed_detection, state_machine

POINT = "traj_id long, seq long, ts_ms long, lat double, lon double, h double, x double, y double, vel_e double, vel_n double, vel_u double, pha_e double, pha_n double, quality_score double, trusted boolean, trust_reason int"


def track(n, seed=0, step=10.0, traj=1):
    rng = np.random.default_rng(seed)
    out = []
    t = 1678330000000
    for i in range(n):
        t += 1000 if rng.random() > 0.05 else 8000
        x, y = step * i + rng.normal(0, 3), rng.normal(0, 3)
        out.append((traj, i, t, 30 + y * 9e-6, 120 + x * 1e-5, 5.0, float(x), float(y), 10.0, 0.0, 0.0, 10.0 if i % 4 else None, 0.0, float(rng.choice([0.3, 0.7, 1.0])), bool(rng.random() > 0.2), 0))
    return out


@pytest.fixture(scope="module")
def points(spark):
    return spark.createDataFrame(track(60) + track(40, 1, 4.0, 2), POINT).cache()


def grid(spark, lanes=1):
    """Two roads eastward and three northward, as segments in metres."""
    rows, k = [], 0
    for y in (0.0, 25.0):
        for i in range(14):
            rows.append((k, 0, 0, 50.0 * i - 50, y, 50.0 * i, y))
            k += 1
    for x in (0.0, 200.0, 400.0):
        for i in range(3):
            rows.append((k, 1, 0, x, 25.0 * i - 25, x, 25.0 * i))
            k += 1
    s = spark.createDataFrame(rows, "seg_id long, road_id long, lane_id int, x1 double, y1 double, x2 double, y2 double")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return s.withColumns({"heading": F.atan2(dy, dx), "len": F.sqrt(dx * dx + dy * dy)})


# Kalman filter: the four-state form with whole matrices


def slow_ekf(rows, o):
    s = p = None
    out, last = [], 0
    for r in rows:
        if s is None:
            s, p = np.array([r.x, r.y, r.vel_e, r.vel_n]), np.diag([o.start_m**2] * 2 + [o.start_mps**2] * 2)
        else:
            dt = (r.ts_ms - last) / 1000
            dt = 1.0 if not 0 < dt <= 10 else dt
            f = np.eye(4)
            f[0, 2] = f[1, 3] = dt
            q = np.diag([o.process_m**2 * dt * dt] * 2 + [o.process_mps**2 * dt] * 2)
            s, p = f @ s, f @ p @ f.T + q
        last = r.ts_ms
        z = [(0, r.x, o.gnss_m**2 * r.gnss_scale), (1, r.y, o.gnss_m**2 * r.gnss_scale), (2, r.vel_e, o.gnss_mps**2 * r.gnss_scale), (3, r.vel_n, o.gnss_mps**2 * r.gnss_scale)]
        if not math.isnan(r.o_x):
            z += [(0, r.o_x, o.road_m**2 * r.road_scale), (1, r.o_y, o.road_m**2 * r.road_scale)]
        for i, v, n in z:
            k = p[:, i] / (p[i, i] + n)
            s = s + k * (v - s[i])
            p = p - np.outer(k, p[i])
            p = (p + p.T) / 2
        assert np.linalg.eigvalsh(p).min() > 0
        out.append(s)
    return np.array(out)


def test_two_small_filters_are_the_large_one():
    rng = np.random.default_rng(3)
    n = 200
    pdf = pd.DataFrame({"traj_id": 1, "seq": range(n), "ts_ms": np.cumsum(rng.choice([1000, 500, 20000, 0], n)), "x": rng.normal(0, 9, n), "y": rng.normal(0, 9, n), "vel_e": rng.normal(0, 3, n), "vel_n": rng.normal(0, 3, n), "gnss_scale": rng.uniform(1, 9, n), "o_x": np.where(rng.random(n) > 0.4, rng.normal(0, 3, n), np.nan), "o_y": 0.5, "road_scale": rng.uniform(1, 9, n)})
    pdf.loc[pdf["o_x"].isna(), "o_y"] = np.nan
    got = ekf.fold(pdf, Ekf())[["x", "y", "v_e", "v_n"]].to_numpy()
    assert got == pytest.approx(slow_ekf(list(pdf.itertuples()), Ekf()), abs=1e-8)


def test_fusion_leaves_out_points_without_a_place_and_meets_the_track(spark, points):
    track_ = points.select("traj_id", "seq", "ts_ms", (F.col("seq") * 10.0).alias("x"), F.lit(0.0).alias("y"), "h", F.lit(1.0).alias("quality_score"), F.lit(True).alias("trusted"))
    bad = points.withColumn("lat", F.when(F.col("seq") == 5, None).otherwise(F.col("lat")))
    got = ekf.fuse(bad.where("traj_id = 1"), track_, (30.0, 120.0)).toPandas()
    assert len(got) == 59 and 5 not in set(got["seq"])
    assert (got["quality_score"].between(0, 1)).all() and got.loc[got["seq"] > 10, "y"].abs().max() < 1.0


# as-of joins


def slow_nearest(ts, right, tol, later):
    """A cursor through the rows in order: on the last row at or before, then to the next one if that is nearer; later: as long as no farther."""
    at = 0
    if later:
        for i in range(1, len(right)):
            if abs(right[i] - ts) <= abs(right[at] - ts):
                at = i
    else:
        while at + 1 < len(right) and right[at + 1] <= ts:
            at += 1
        if at + 1 < len(right) and abs(right[at + 1] - ts) < abs(right[at] - ts):
            at += 1
    return at if abs(right[at] - ts) <= tol else None


def test_matched_observations_by_a_cursor(spark):
    """Repeated times, missing quality and missing places, against the rows gone through in order."""
    rng = np.random.default_rng(4)
    track = [(int(t), x if rng.random() > 0.15 else None, 1.0, rng.choice([0.2, 0.9, None]), bool(rng.random() > 0.3)) for t, x in zip(np.sort(rng.integers(0, 60, 45)) * 100, rng.uniform(0, 9, 45).tolist(), strict=True)]
    track = [(t, x, y, None if q is None else float(q), ok) for t, x, y, q, ok in track]
    times = rng.integers(-15, 75, 120) * 100
    left = spark.createDataFrame([(1, i, int(t)) for i, t in enumerate(times)], "traj_id long, seq long, ts_ms long")
    right = spark.createDataFrame([(1, i, *r, 5.0) for i, r in enumerate(track)], "traj_id long, seq long, ts_ms long, x double, y double, quality_score double, trusted boolean, h double").repartition(4)
    got = {r.seq: (r.o_x, r.o_quality, r.o_trusted) for r in asof.matched(left, right).collect()}
    quality = lambda q: 1.0 if q is None else q
    for i, ts in enumerate(times.tolist()):
        at = slow_nearest(ts, [r[0] for r in track], 1000, False)
        cursor = max([k for k, r in enumerate(track) if r[0] <= ts], default=0)
        want = (None, None, None)
        if at is not None:
            a, b = track[cursor], track[cursor + 1] if cursor + 1 < len(track) else None
            if b and a[0] <= ts <= b[0] and b[0] > a[0] and a[1] is not None and b[1] is not None:
                share = (ts - a[0]) / (b[0] - a[0])
                want = (a[1] + (b[1] - a[1]) * share, quality(a[3]) + (quality(b[3]) - quality(a[3])) * share, a[4] and b[4])
            elif track[at][1] is not None:
                want = (track[at][1], quality(track[at][3]), track[at][4])
        assert got[i] == (want if want[0] is None else (pytest.approx(want[0]), pytest.approx(want[1]), want[2])), (i, ts)


def test_missing_values_stay_missing(spark):
    rows = spark.createDataFrame([(None,), (-1.0,), (0.5,), (9.0,)], "v double").select(geo.clamp(F.col("v"), 0.05, 1.0).alias("v")).collect()
    assert [r.v for r in rows] == [None, 0.05, 0.5, 1.0]


def test_only_wanted_ways_are_searched(spark):
    segs = grid(spark)
    e = roads.edges(segs, roads.merged_nodes(segs))
    whole = {(r.src, r.dst): r.d for r in roads.shortest_paths(e, e.select("src")).collect()}
    some = sorted(whole)[::7]
    found = roads.wanted_paths(e, spark.createDataFrame([*some, (some[0][0], -5)], "src long, dst long")).collect()
    assert {(r.src, r.dst): r.d for r in found} == {k: pytest.approx(whole[k]) for k in some} and len(found) == len(some)


@pytest.mark.parametrize("tie", ["earlier", "later"])
def test_nearest_with_ties_and_repeats(spark, tie):
    rng = np.random.default_rng(8)
    right = sorted(rng.integers(0, 400, 60).tolist())
    left = rng.integers(-30, 430, 200).tolist()
    ldf = spark.createDataFrame([(1, i, t * 100) for i, t in enumerate(left)], "traj_id long, seq long, ts_ms long")
    rdf = spark.createDataFrame([(1, i, t * 100, i) for i, t in enumerate(right)], "traj_id long, seq long, ts_ms long, v long")
    got = {r.seq: r.v for r in asof.nearest(ldf, rdf, ("v",), 1000, tie).collect()}
    assert got == {i: slow_nearest(t * 100, [x * 100 for x in right], 1000, tie == "later") for i, t in enumerate(left)}


# hidden-Markov matching


def test_viterbi_finds_the_least_cost_of_all_paths(spark):
    rng = np.random.default_rng(5)
    emit, trans, steps = [], [], []
    e = rng.uniform(0, 9, (6, 3)).round(3)
    t = rng.uniform(0, 9, (6, 3, 3)).round(3)
    for i in range(6):
        steps.append((1, i, 0))
        emit += [(1, i, k, float(e[i, k])) for k in range(3)]
        trans += [(1, 0, i, a, b, float(t[i, a, b])) for a in range(3) for b in range(3)] if i else []
    got = hmm.viterbi(
        spark.createDataFrame(emit, "traj_id long, seq long, cand int, emit_cost double"),
        spark.createDataFrame(steps, "traj_id long, seq long, chain_id long"),
        spark.createDataFrame(trans, "traj_id long, chain_id long, seq long, p_cand int, cand int, trans_cost double"),
    ).orderBy("seq").collect()
    cost = lambda p: e[0, p[0]] + sum(e[i, p[i]] + t[i, p[i - 1], p[i]] for i in range(1, 6))
    best = min(itertools.product(range(3), repeat=6), key=cost)
    assert tuple(r.cand for r in got) == best and got[-1].cost == pytest.approx(cost(best))


def test_candidates_are_the_nearest_eight_or_the_very_nearest(spark):
    segs = grid(spark)
    far = spark.createDataFrame([(1, 0, 100.0, 3.0), (1, 1, 100.0, 400.0), (1, 2, 5000.0, 0.0), (1, 3, 200.0, 12.0)], "traj_id long, seq long, x double, y double")
    got = hmm.candidates(far, segs).toPandas()
    table = segs.toPandas()
    for seq, x, y in [(r.seq, r.x, r.y) for r in far.collect()]:
        t = np.clip(((x - table.x1) * (table.x2 - table.x1) + (y - table.y1) * (table.y2 - table.y1)) / table.len**2, 0, 1)
        d = np.hypot(table.x1 + t * (table.x2 - table.x1) - x, table.y1 + t * (table.y2 - table.y1) - y)
        near = sorted((v, s) for v, s in zip(d, table.seg_id, strict=True) if v <= Hmm().radius_m)[:8] or [min(zip(d, table.seg_id, strict=True))]
        own = got[got.seq == seq].sort_values("cand")
        assert own.seg_id.tolist() == [s for _, s in near] and own.obs_dist.tolist() == pytest.approx([v for v, _ in near])


def test_hmm_matches_onto_segments_and_never_worse_than_the_greedy_path(spark, points):
    segs = grid(spark)
    out = hmm.match(points, segs).toPandas()
    assert len(out) == 100 and out.seg_id.notna().all()
    s = segs.toPandas().set_index("seg_id").loc[out.seg_id]
    t = ((out.mx.to_numpy() - s.x1) * (s.x2 - s.x1) + (out.my.to_numpy() - s.y1) * (s.y2 - s.y1)) / s.len**2
    assert np.hypot(s.x1 + t * (s.x2 - s.x1) - out.mx.to_numpy(), s.y1 + t * (s.y2 - s.y1) - out.my.to_numpy()).max() < 1e-6
    assert out.quality_score.between(0.05, 1).all()


# road networks


def test_shortest_paths_are_those_of_floyd_and_warshall(spark):
    segs = grid(spark)
    nodes = roads.merged_nodes(segs)
    e = roads.edges(segs, nodes)
    got = {(r.src, r.dst): r.d for r in roads.shortest_paths(e, e.select("src")).collect()}
    pdf = e.toPandas()
    ids = sorted(set(pdf.src))
    d = {(a, b): 0.0 if a == b else math.inf for a in ids for b in ids} | {(r.src, r.dst): r.w for r in pdf.itertuples()}
    for k in ids:
        for a in ids:
            for b in ids:
                d[a, b] = min(d[a, b], d[a, k] + d[k, b])
    want = {k: v for k, v in d.items() if v < math.inf}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_nodes_merge_in_file_order(spark):
    """A chain of ends 2 m apart: the first takes all within 3 m of itself, not all that are connected."""
    rows = [(i, 0, 0, 2.0 * i, 0.0, 2.0 * i, 500.0 + 10 * i) for i in range(5)] + [(9, 0, 0, 100.0, 3.0, 103.0, 3.0), (10, 0, 0, 103.1, 3.0, 200.0, 3.0)]
    s = spark.createDataFrame(rows, "seg_id long, road_id long, lane_id int, x1 double, y1 double, x2 double, y2 double").withColumn("len", F.lit(500.0))
    got = {r.seg_id: (r.u, r.v) for r in roads.merged_nodes(s).collect()}
    made, want = [], {}
    for i, _, _, x1, y1, x2, y2 in rows:
        own = []
        for k, (x, y) in enumerate(((x1, y1), (x2, y2))):
            hit = next((n for n, a, b in made if math.hypot(a - x, b - y) <= 3.0), None)
            if hit is None:
                hit = 2 * i + k
                made.append((hit, x, y))
            own.append(hit)
        want[i] = tuple(own)
    assert got == want


def test_adjacency_at_its_limit(spark):
    rows = [(1, 0, 0, 0.0, 0.0, 100.0, 0.0), (2, 0, 0, 108.0, 0.0, 200.0, 0.0), (3, 0, 0, 208.1, 0.0, 300.0, 0.0)]
    s = spark.createDataFrame(rows, "seg_id long, road_id long, lane_id int, x1 double, y1 double, x2 double, y2 double")
    assert {(r.seg_id, r.other) for r in roads.adjacency(s).collect()} == {(1, 2), (2, 1)}


# state machine


def test_matcher_follows_its_road_and_is_independent_of_other_trajectories(spark, points):
    segs = grid(spark)
    for sd in (False, True):
        both = state_machine.match(points, segs, sd).toPandas().sort_values(["traj_id", "seq"])
        one = state_machine.match(points.where("traj_id = 2"), segs, sd).toPandas().sort_values("seq")
        assert len(both) == 100 and both.seg_id.notna().all()
        assert both[both.traj_id == 2].mx.tolist() == one.mx.tolist()
        assert both.quality_score.between(0.08, 1).all()
        east = both[(both.traj_id == 1) & (both.seq > 5)]
        assert (east.my.abs() <= 30).all() and np.median(np.abs(east.mx - 10 * east.seq)) < 12


def test_vote_is_the_folds_vote(spark, points):
    segs = grid(spark)
    net = state_machine.Roads(segs.toPandas(), roads.adjacency(segs).toPandas())
    got = {(r.traj_id, r.seq): r.seg_id for r in state_machine.segment_votes(points, segs).collect()}
    for traj in (1, 2):
        pdf = points.where(f"traj_id = {traj}").orderBy("seq").toPandas()
        m = state_machine.Matcher(net, pdf.astype(object).where(pdf.notna(), None), False, 0)
        for i in range(len(pdf)):
            if (traj, i) in got:
                assert int(net.ids[m.vote(i)]) == got[traj, i]


def test_matcher_without_roads_keeps_raw_places(spark, points):
    none = grid(spark).where("false")
    out = state_machine.match(points, none).toPandas().merge(points.toPandas(), on=["traj_id", "seq"])
    assert out.seg_id.isna().all() and (out.mx == out.x).all()


# scalars, windows, frames


def test_angles_and_facing(spark):
    rng = np.random.default_rng(1)
    rows = [(float(a), float(b)) for a, b in rng.uniform(-9, 9, (200, 2))]
    got = spark.createDataFrame(rows, "a double, b double").select(geo.angle_diff(F.col("a"), F.col("b")), geo.heading_diff_both_ways(F.col("a"), F.col("b"))).collect()
    for (a, b), r in zip(rows, got, strict=True):
        assert r[0] == pytest.approx(abs(math.remainder(a - b, 2 * math.pi)), abs=1e-12)
        assert r[1] == pytest.approx(state_machine.both_ways(a, b), abs=1e-12)


def test_chains_break_on_gaps_and_backward_steps(spark):
    t = [0, 5000, 10999, 16000, 15000, 15000, -1500, 2000]
    df = spark.createDataFrame([(1, i, x) for i, x in enumerate(t)], "traj_id long, seq long, ts_ms long")
    assert [r.chain_id for r in observations.chains(df).orderBy("seq").collect()] == [0, 0, 0, 1, 2, 2, 3, 4]


def test_detection_leaves_bad_steps_alone(spark):
    rows = [(1, i, t, x, 0.0, 10.0, 0.0, 1.0, False, 7) for i, (t, x) in enumerate([(0, 0.0), (1000, 10.0), (1050, 500.0), (12000, 900.0), (13000, 911.0), (14000, 940.0), (15000, None)])]
    df = spark.createDataFrame(rows, "traj_id long, seq long, ts_ms long, x double, y double, v_e double, v_n double, quality_score double, trusted boolean, trust_reason int")
    got = speed_detection.prediction(df).orderBy("seq").collect()
    assert [r.trusted for r in got] == [True, True, True, True, True, False, True]
    assert [r.trust_reason for r in got] == [0, 0, 0, 0, 0, 20, 0]
    assert [r.quality_score for r in got] == [1, 1, 1, 1, 1, 0.15, 1]


def test_noise_scale_of_missing_quality(spark):
    df = spark.createDataFrame([(None, True), (float("nan"), False), (0.1, True), (0.5, False)], "q double, t boolean")
    assert [r[0] for r in df.select(quality.noise_scale(F.col("q"), F.col("t"))).collect()] == pytest.approx([1.0, 4.0, 25.0, 16.0])


def test_window_table_is_the_window_list(spark):
    df = spark.createDataFrame([(1, i, 1678330400000 + i * 60_000) for i in range(200)], "traj_id long, seq long, ts_ms long")
    from waymill.functions.constants import EXCLUDE_WINDOWS

    table = spark.createDataFrame(list(EXCLUDE_WINDOWS), "low long, high long")
    want = [r.seq for r in df.orderBy("seq").collect() if not any(a <= r.ts_ms <= b for a, b in EXCLUDE_WINDOWS)]
    assert sorted(r.seq for r in observations.exclude_by_table(df, table).collect()) == want
