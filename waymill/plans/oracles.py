"""SQL equivalents of the registered queries, for DuckDB over the same tables."""

from __future__ import annotations

from ..functions.constants import EXCLUDE_WINDOWS, KEEP_WINDOW, LANE_OFFSETS
from ..operators.lane_candidates import STATES
from .registry import ORACLES

R = 6378137.0
K = "CAST(floor(event_id / 500e0) AS BIGINT) traj_id, event_id % 500 seq"

STILL = "event_id % 500 BETWEEN 200 AND 209"
OBS = f"""obs AS (SELECT {K}, 1678330000000 + event_id * 1000 - CASE WHEN event_id % 331 = 0 THEN 3000 ELSE 0 END ts_ms,
 30e0 + CASE WHEN event_id % 211 = 0 THEN 200e0 ELSE (event_id % 7) * 0.5e0 END * 0.9e-5 lat,
 120e0 + CASE WHEN {STILL} THEN 2130e0 + value / 1000e0 ELSE 10e0 * (event_id % 500) + value / 10e0 END * 1.04e-5 lon, 10e0 + event_id % 5 h,
 CASE WHEN event_id % 37 <> 0 THEN CASE WHEN {STILL} THEN 0e0 ELSE 10e0 END END vel_e, CASE WHEN {STILL} THEN 0e0 ELSE (event_id % 3 - 1) * 0.2e0 END vel_n,
 CASE WHEN event_id % 11 <> 0 THEN CASE WHEN {STILL} THEN 0e0 ELSE 10e0 + (event_id % 3) * 0.1e0 END END pha_e, 0e0 pha_n,
 CASE WHEN event_id % 4 = 0 THEN 0.3e0 ELSE 1e0 END quality_score, event_id % 6 <> 0 trusted
 FROM events WHERE NOT (event_id % 500 BETWEEN 100 AND 109) AND NOT (event_id % 500 BETWEEN 300 AND 306))"""
PTS = OBS + f""", pts AS (SELECT *, {R}e0 * radians(lon - 120e0) * cos(radians(30e0)) x, {R}e0 * radians(lat - 30e0) y FROM obs)"""
TRUTH = f"""truth AS (SELECT {K}, 1678330000000 + event_id * 1000 + (event_id % 3 - 1) * 700 ts_ms, 30e0 + (event_id % 7) * 0.5e0 * 0.9e-5 lat,
 120e0 + (10e0 * (event_id % 500) + (event_id % 5) * 0.3e0) * 1.04e-5 lon FROM events WHERE event_id % 13 <> 0)"""
TRACK = f"""track AS (SELECT {K}, 1678330000000 + event_id * 1000 + CASE WHEN event_id % 29 = 0 THEN 1000 ELSE event_id % 4 * 200 END ts_ms,
 CASE WHEN event_id % 23 <> 0 THEN 10e0 * (event_id % 500) + (event_id % 4) * 2e0 END x, 0e0 y,
 CASE WHEN event_id % 17 <> 0 THEN 0.5e0 + (event_id % 5) * 0.1e0 END quality_score, event_id % 9 <> 0 trusted FROM events WHERE event_id % 10 <> 0),
 track_last AS (SELECT * FROM track QUALIFY row_number() OVER (PARTITION BY traj_id, ts_ms ORDER BY seq DESC) = 1),
 track_first AS (SELECT * FROM track QUALIFY row_number() OVER (PARTITION BY traj_id, ts_ms ORDER BY seq) = 1)"""
LAG = "(PARTITION BY traj_id ORDER BY seq)"
VERT = """verts AS (SELECT road_id, k, 30e0 + yy * 0.9e-5 lat, 120e0 + xx * 1.04e-5 lon FROM (
 SELECT i road_id, k, -50e0 + 50e0 * k xx, 20e0 * (i - 1) yy FROM range(0, 3) a(i), range(0, 103) b(k)
 UNION ALL SELECT i, k, 500e0 * (i - 3), -60e0 + 20e0 * k FROM range(3, 14) a(i), range(0, 7) b(k)))"""
SEGS = (
    VERT
    + f""", vxy AS (SELECT *, {R}e0 * radians(lon - 120e0) * cos(radians(30e0)) x, {R}e0 * radians(lat - 30e0) y FROM verts),
 segs AS (SELECT a.road_id * 1048576 + a.k seg_id, a.road_id, a.x x1, a.y y1, b.x x2, b.y y2, atan2(b.y - a.y, b.x - a.x) heading,
 sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)) len FROM vxy a JOIN vxy b ON a.road_id = b.road_id AND b.k = a.k + 1)"""
)
PROJ = """raw AS (SELECT traj_id, seq, seg_id, p.x, p.y, heading, x1, y1, x2, y2, len, greatest(0e0, least(1e0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / (len * len))) t
 FROM pts p JOIN segs ON p.x BETWEEN least(x1, x2) - 40 AND greatest(x1, x2) + 40 AND p.y BETWEEN least(y1, y2) - 40 AND greatest(y1, y2) + 40),
 proj AS (SELECT *, x1 + (x2 - x1) * t px, y1 + (y2 - y1) * t py, t * len s FROM raw),
 near AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) obs_dist FROM proj)"""
# a point without a segment within 35 m has the nearest of all
CAND = PROJ + """, far0 AS (SELECT traj_id, seq, seg_id, p.x, p.y, heading, x1, y1, x2, y2, len, greatest(0e0, least(1e0, ((p.x - x1) * (x2 - x1) + (p.y - y1) * (y2 - y1)) / (len * len))) t
 FROM pts p, segs WHERE NOT EXISTS (SELECT 1 FROM near n WHERE n.traj_id = p.traj_id AND n.seq = p.seq AND obs_dist <= 35)),
 far AS (SELECT *, sqrt((x - px) * (x - px) + (y - py) * (y - py)) obs_dist FROM (SELECT *, x1 + (x2 - x1) * t px, y1 + (y2 - y1) * t py, t * len s FROM far0)),
 cands AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY traj_id, seq ORDER BY obs_dist, seg_id) - 1 AS INTEGER) cand FROM near WHERE obs_dist <= 35) WHERE cand < 8
 UNION ALL SELECT * EXCLUDE (rk), 0 cand FROM (SELECT *, row_number() OVER (PARTITION BY traj_id, seq ORDER BY obs_dist, seg_id) rk FROM far) WHERE rk = 1)"""


def r(x: str, n: int = 3) -> str:
    return f"round({x}, {n}) + 0e0"


def ang(a: str, b: str) -> str:
    return f"abs(({a}) - ({b}) - 2e0 * pi() * round((({a}) - ({b})) / (2e0 * pi())))"


SD = f"""sd0 AS (SELECT *, (ts_ms - lag(ts_ms) OVER w) / 1000e0 dt, x - (lag(x) OVER w + lag(vel_e) OVER w * ((ts_ms - lag(ts_ms) OVER w) / 1000e0)) dx,
 y - (lag(y) OVER w + lag(vel_n) OVER w * ((ts_ms - lag(ts_ms) OVER w) / 1000e0)) dy FROM pts WINDOW w AS {LAG}),
 sd1 AS (SELECT *, CASE WHEN dt > 0.05e0 AND dt <= 10 THEN sqrt(dx * dx + dy * dy) END residual_m FROM sd0),
 sd AS (SELECT * REPLACE (coalesce(residual_m <= 12, TRUE) AS trusted, CASE WHEN residual_m IS NULL OR residual_m <= 5 THEN 1e0
 WHEN residual_m >= 12 THEN 0.15e0 ELSE 1e0 - 0.85e0 * (residual_m - 5e0) / 7e0 END AS quality_score), CASE WHEN residual_m > 12 THEN 20 ELSE 0 END trust_reason FROM sd1)"""
SPEED = """sp AS (SELECT *, sqrt(pha_e * pha_e + pha_n * pha_n) ps, sqrt(vel_e * vel_e + vel_n * vel_n) ds FROM pts),
 spd AS (SELECT *, CASE WHEN ps BETWEEN 0.05e0 AND 60 THEN pha_e WHEN ds BETWEEN 0.05e0 AND 60 THEN vel_e END speed_e,
 CASE WHEN ps BETWEEN 0.05e0 AND 60 THEN pha_n WHEN ds BETWEEN 0.05e0 AND 60 THEN vel_n END speed_n FROM sp)"""
EX = " OR ".join(f"ts_ms BETWEEN {a} AND {b}" for a, b in EXCLUDE_WINDOWS)
KEEP = f"ts_ms BETWEEN {KEEP_WINDOW[0]} AND {KEEP_WINDOW[1]}"


def q(name: str, *ctes: str, sql: str) -> None:
    ORACLES[name] = ("WITH " + ", ".join(ctes) + " " if ctes else "") + sql


q("sd_anomaly_counts", PTS, SD, sql="SELECT traj_id, count(*) n, count(*) FILTER (NOT trusted) n_untrusted, count(*) FILTER (quality_score < 0.35e0) n_low FROM sd GROUP BY 1")
q("gps_time_ms", OBS, sql="SELECT traj_id, seq, CAST(round((wk * 604800e0 + (since - wk * 604800e0) + 315964800e0) * 1000e0) AS BIGINT) ts_ms FROM (SELECT *, floor(since / 604800e0) wk FROM (SELECT *, ts_ms / 1000e0 - 315964800e0 since FROM obs))")
q("time_window_filter", OBS, sql=f"SELECT traj_id, seq, ts_ms FROM obs WHERE {KEEP} AND NOT ({EX})")
q("time_window_rejects", OBS, sql=f"SELECT CASE WHEN ts_ms < 0 THEN 'bad_time' WHEN NOT {KEEP} THEN 'outside' WHEN {EX} THEN 'excluded' ELSE 'kept' END reason, count(*) n FROM obs GROUP BY 1")
q("time_window_exclude_table", OBS, sql=f"SELECT traj_id, seq, ts_ms FROM obs WHERE NOT ({EX})")
q("local_ref", OBS, sql=f"SELECT traj_id, {r('avg(lat)', 8)} lat0, {r('avg(lon)', 8)} lon0, {r('cos(radians(avg(lat)))', 8)} cos0 FROM obs GROUP BY 1")
q("ll_to_xy", PTS, sql=f"SELECT traj_id, seq, {r('x')} x, {r('y')} y FROM pts")
q("xy_to_ll", PTS, sql=f"SELECT traj_id, seq, {r(f'30e0 + degrees((y + 1.5e0) / {R}e0)', 8)} lat, {r(f'120e0 + degrees((x - 2.5e0) / ({R}e0 * cos(radians(30e0))))', 8)} lon FROM pts")
_HAV = "pow(sin((radians({b1}) - radians({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({b1})) * pow(sin(radians({b2} - {a2}) / 2), 2)"


def hav(a1: str, a2: str, b1: str, b2: str) -> str:
    h = _HAV.format(a1=a1, a2=a2, b1=b1, b2=b2)
    return f"2 * {R}e0 * atan2(sqrt({h}), sqrt(1 - ({h})))"


q("haversine_step", OBS, sql=f"SELECT traj_id, seq, {r('(ts_ms - lt) / 1000e0')} dt_s, {r(hav('la', 'lo', 'lat', 'lon'))} step_m FROM (SELECT *, lag(lat) OVER w la, lag(lon) OVER w lo, lag(ts_ms) OVER w lt FROM obs WINDOW w AS {LAG})")
STEP = f"st AS (SELECT *, (ts_ms - lag(ts_ms) OVER w) / 1000e0 dt_s, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) step_m FROM pts WINDOW w AS {LAG})"
q("planar_step", PTS, STEP, sql=f"SELECT traj_id, seq, {r('dt_s')} dt_s, {r('step_m')} step_m FROM st")
_A, _B = "seq * 0.37e0 - 40e0", "seq * 0.11e0"
q("angle_diff", OBS, sql=f"SELECT traj_id, seq, {r(ang(_A, _B), 6)} diff FROM obs")
_BOTH = f"least({ang(_A, _B)}, {ang(_A, _B + ' + pi()')})"
q("heading_bidirectional", OBS, sql=f"SELECT traj_id, seq, {r(_BOTH, 6)} diff, {r(_BOTH, 6)} faced FROM obs")
_DI = "greatest(0e0, least(1e0, 1.064e0 * exp(-pow(({}) / 35.37e0 + 8.703e0 / 35.37e0, 2))))"
_HI = "greatest(0e0, least(1e0, 7.973e0 * exp(-pow((degrees({}) + 204.4e0) / 141.8e0, 2))))"
q("paper_indices", OBS, sql=f"SELECT traj_id, seq, {r(_DI.format('seq * 0.2e0'), 6)} distance_index, {r(_HI.format('seq * 0.006e0'), 6)} heading_index FROM obs")
q("valid_speed_en", PTS, SPEED, sql=f"SELECT traj_id, seq, {r('speed_e', 6)} speed_e, {r('speed_n', 6)} speed_n, {r('sqrt(speed_e * speed_e + speed_n * speed_n)', 6)} speed, CASE WHEN sqrt(speed_e * speed_e + speed_n * speed_n) > 0.35e0 THEN {r('atan2(speed_n, speed_e)', 6)} END speed_heading FROM spd")
q("sd_prediction", PTS, SD, sql=f"SELECT traj_id, seq, {r('residual_m')} residual_m, trusted, trust_reason, {r('quality_score')} quality_score FROM sd")
q(
    "sd_three_sigma", PTS, STEP,
    "v AS (SELECT *, CASE WHEN dt_s > 0.05e0 AND dt_s <= 10 THEN step_m / dt_s END speed_mps FROM st)",
    "g AS (SELECT *, avg(speed_mps) OVER p m, stddev_samp(speed_mps) OVER p sg, count(speed_mps) OVER p c FROM v WINDOW p AS (PARTITION BY traj_id))",
    "j AS (SELECT *, CASE WHEN c >= 3 AND sg >= 1e-6 AND speed_mps IS NOT NULL THEN abs(speed_mps - m) END res FROM g)",
    sql=f"SELECT traj_id, seq, {r('speed_mps')} speed_mps, coalesce(res <= 3 * sg, TRUE) trusted, CASE WHEN res > 3 * sg THEN 10 ELSE 0 END trust_reason, {r('CASE WHEN res IS NULL OR res <= 2 * sg THEN 1e0 WHEN res >= 3 * sg THEN 0.15e0 ELSE 1e0 - 0.85e0 * (res - 2 * sg) / sg END')} quality_score FROM j",
)
q("sd_off", OBS, sql="SELECT traj_id, seq, TRUE trusted, 0 trust_reason, 1e0 quality_score FROM obs")
_SM = "greatest(0e0, least(1e0, (coalesce(residual_m, 0e0) - 5e0) / {}e0))"


def smooth(n: int) -> str:
    x = _SM.format(n)
    return f"({x}) * ({x}) * (3e0 - 2e0 * ({x}))"


q("sd_quality_noise", PTS, SD, sql=f"SELECT traj_id, seq, {r('1e0 / pow(greatest(0.2e0, least(1e0, quality_score)), 2) * CASE WHEN trusted THEN 1e0 ELSE 4e0 END')} scale, {r(f'1e0 - 0.92e0 * ({smooth(7)})')} smooth_quality, {r(smooth(15))} severity FROM sd")
CHAIN = f"""ch0 AS (SELECT *, CASE WHEN ts_ms // 1000 - lag(ts_ms // 1000) OVER w > 5 OR ts_ms // 1000 - lag(ts_ms // 1000) OVER w < 0 THEN 1 ELSE 0 END opens FROM pts WINDOW w AS {LAG}),
 ch AS (SELECT *, CAST(sum(opens) OVER (PARTITION BY traj_id ORDER BY seq) AS BIGINT) chain_id FROM ch0)"""
q("chain_split", PTS, CHAIN, sql="SELECT traj_id, chain_id, min(seq) first_seq, max(seq) last_seq, count(*) n FROM ch GROUP BY 1, 2")
HEAD = f"""hd0 AS (SELECT *, CASE WHEN row_number() OVER w = 1 THEN lead(x) OVER w - x ELSE x - lag(x) OVER w END hx, CASE WHEN row_number() OVER w = 1 THEN lead(y) OVER w - y ELSE y - lag(y) OVER w END hy FROM pts WINDOW w AS {LAG}),
 hd AS (SELECT *, CASE WHEN hx * hx + hy * hy > 1 THEN atan2(hy, hx) END obs_heading FROM hd0)"""
q("obs_heading", PTS, HEAD, sql=f"SELECT traj_id, seq, {r('obs_heading', 5)} obs_heading FROM hd")


def asof(right: str, left: str, cols: tuple[str, ...], tolerance: int, later: bool) -> str:
    """The nearest row on either side by two as-of joins."""
    pick = "CASE WHEN s_ts IS NOT NULL AND (p_ts IS NULL OR s_ts - ts_ms {} ts_ms - p_ts) THEN s_{{0}} ELSE p_{{0}} END".format("<=" if later else "<")
    side = lambda a: ", ".join(f"{a}.{c} {a}_{c}" for c in cols)
    before, after = (right, right) if later else (f"{right}_last", f"{right}_first")
    return f"""both_ AS (SELECT l.*, p.ts_ms p_ts, {side('p')}, s.ts_ms s_ts, {side('s')} FROM {left} l ASOF LEFT JOIN {before} p ON l.traj_id = p.traj_id AND l.ts_ms >= p.ts_ms
 ASOF LEFT JOIN {after} s ON l.traj_id = s.traj_id AND l.ts_ms < s.ts_ms),
 best_ AS (SELECT *, {pick.format('ts')} b_ts, {', '.join(f'{pick.format(c)} b_{c}' for c in cols)} FROM both_),
 got AS (SELECT *, abs(b_ts - ts_ms) <= {tolerance} ok FROM best_)"""


q("truth_asof_nearest", OBS, TRUTH, asof("truth", "obs", ("lat", "lon"), 2000, True), sql=f"SELECT traj_id, seq, CASE WHEN ok THEN b_ts END m_ts, CASE WHEN ok THEN {r('b_lat', 8)} END lat, CASE WHEN ok THEN {r('b_lon', 8)} END lon FROM got")
EVAL = f"ev AS (SELECT traj_id, seq, {hav('lat', 'lon', 'b_lat', 'b_lon')} error_m, NOT trusted OR quality_score < 0.35e0 sd_abnormal FROM got WHERE ok)"
q("sd_eval_rows", PTS, SD, TRUTH, asof("truth", "sd", ("lat", "lon"), 2000, True), EVAL, sql=f"SELECT traj_id, seq, {r('error_m')} error_m, error_m > 5 truth_abnormal, sd_abnormal FROM ev")
q(
    "sd_eval_metrics", PTS, SD, TRUTH, asof("truth", "sd", ("lat", "lon"), 2000, True), EVAL,
    "c AS (SELECT count(*) n, count(*) FILTER (error_m > 5 AND sd_abnormal) tp, count(*) FILTER (error_m <= 5 AND sd_abnormal) fp, count(*) FILTER (error_m > 5 AND NOT sd_abnormal) fn, count(*) FILTER (error_m <= 5 AND NOT sd_abnormal) tn, coalesce(sqrt(avg(error_m * error_m)), 0e0) rmse_m, coalesce(max(error_m), 0e0) max_m FROM ev)",
    "d AS (SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE ELSE 0e0 END recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE ELSE 0e0 END prec, CASE WHEN n > 0 THEN (tp + fp) / n::DOUBLE ELSE 0e0 END share FROM c)",
    sql=f"SELECT n, tp, fp, fn, tn, {r('rmse_m')} rmse_m, {r('max_m')} max_m, {r('recall', 6)} recall, {r('prec', 6)} \"precision\", {r('CASE WHEN prec + recall > 0 THEN 2 * prec * recall / (prec + recall) ELSE 0e0 END', 6)} f1, {r('share', 6)} abnormal_share FROM d",
)
q("matched_asof_nearest", OBS, TRACK, asof("track", "obs", ("x", "quality_score"), 1000, False), sql=f"SELECT traj_id, seq, CASE WHEN ok THEN b_ts END m_ts, CASE WHEN ok THEN {r('b_x')} END x, CASE WHEN ok THEN {r('b_quality_score')} END quality_score FROM got")
_MID = "{1} + ({2} - {1}) * ((ts_ms - p_ts) / (s_ts - p_ts)::DOUBLE)"
MATCHED = asof("track", "{left}", ("x", "y", "quality_score", "trusted"), 1000, False) + f""",
 ways_ AS (SELECT *, ok AND p_ts IS NOT NULL AND s_ts IS NOT NULL AND p_x IS NOT NULL AND s_x IS NOT NULL between_, ok AND b_x IS NOT NULL alone_ FROM got),
 joined AS (SELECT *, CASE WHEN ok THEN b_ts END m_ts, CASE WHEN ok THEN b_quality_score END n_quality,
 CASE WHEN between_ THEN {_MID.format("x", "p_x", "s_x")} WHEN alone_ THEN b_x END o_x, CASE WHEN between_ THEN {_MID.format("y", "p_y", "s_y")} WHEN alone_ THEN b_y END o_y,
 CASE WHEN between_ THEN {_MID.format("q", "coalesce(p_quality_score, 1e0)", "coalesce(s_quality_score, 1e0)")} WHEN alone_ THEN coalesce(b_quality_score, 1e0) END o_quality,
 CASE WHEN between_ THEN p_trusted AND s_trusted WHEN alone_ THEN b_trusted END o_trusted FROM ways_)"""
q("matched_asof_interpolate", OBS, TRACK, MATCHED.format(left="obs"), sql=f"SELECT traj_id, seq, m_ts, {r('o_x')} o_x, {r('o_y')} o_y, {r('o_quality')} o_quality, o_trusted, {r('n_quality')} n_quality FROM joined")


def kalman(left: str) -> str:
    """The filter over `joined`, a row a round. Both axes have one covariance (a, b; b, c), as they start alike and are measured alike."""
    scale = "1e0 / pow(greatest(0.2e0, least(1e0, coalesce({}, 1e0))), 2) * CASE WHEN coalesce({}, TRUE) THEN 1e0 ELSE 4e0 END"
    ready = f"""ready AS (SELECT *, row_number() OVER {LAG} rn, {scale.format("quality_score", "trusted")} gs, {scale.format("o_quality", "o_trusted")} rs, vel_e IS NOT NULL AND vel_n IS NOT NULL moves,
 CASE WHEN (ts_ms - lag(ts_ms) OVER {LAG}) / 1000e0 > 0 AND (ts_ms - lag(ts_ms) OVER {LAG}) / 1000e0 <= 10 THEN greatest(0.001e0, (ts_ms - lag(ts_ms) OVER {LAG}) / 1000e0) ELSE 1e0 END gap FROM joined)"""
    state = ("px", "vx", "py", "vy", "a", "b", "c")
    own = "traj_id, seq, rn, x, y, vel_e, vel_n, gs, rs, moves, o_x, o_y"

    def step(source: str, changes: dict[str, str]) -> str:
        return f"SELECT {own}, {', '.join(f'{changes.get(c, c)} {c}' for c in state)} FROM ({source})"

    def place(source: str, zx: str, zy: str, noise: str, when: str) -> str:
        k, g = f"(a / (a + {noise}))", f"(b / (a + {noise}))"
        new = {"px": f"px + {k} * ({zx} - px)", "vx": f"vx + {g} * ({zx} - px)", "py": f"py + {k} * ({zy} - py)", "vy": f"vy + {g} * ({zy} - py)", "c": f"c - {g} * b", "b": f"b * (1 - {k})", "a": f"a * (1 - {k})"}
        return step(source, {n: f"CASE WHEN {when} THEN {e} ELSE {n} END" for n, e in new.items()})

    def speed(source: str) -> str:
        k, g = "(b / (c + 2.25e0 * gs))", "(c / (c + 2.25e0 * gs))"
        new = {"px": f"px + {k} * (vel_e - vx)", "vx": f"vx + {g} * (vel_e - vx)", "py": f"py + {k} * (vel_n - vy)", "vy": f"vy + {g} * (vel_n - vy)", "a": f"a - {k} * b", "b": f"b * (1 - {g})", "c": f"c * (1 - {g})"}
        return step(source, {n: f"CASE WHEN moves THEN {e} ELSE {n} END" for n, e in new.items()})

    def measured(source: str) -> str:
        return place(speed(place(source, "x", "y", "36e0 * gs", "TRUE")), "o_x", "o_y", "0.25e0 * rs", "o_x IS NOT NULL")

    names = ", ".join(f"r.{c}" for c in own.split(", "))
    start = f"SELECT {own}, x px, CASE WHEN moves THEN vel_e ELSE 0e0 END vx, y py, CASE WHEN moves THEN vel_n ELSE 0e0 END vy, 64e0 a, 0e0 b, 9e0 c FROM ready WHERE rn = 1"
    ahead = f"""SELECT {names}, px + vx * gap px, vx, py + vy * gap py, vy, a + 2 * gap * b + gap * gap * c + 0.64e0 * gap * gap a, b + gap * c b, c + 0.36e0 * gap c
 FROM kf k JOIN ready r ON r.traj_id = k.traj_id AND r.rn = k.rn + 1"""
    return f"{MATCHED.format(left=left)}, {ready}, kf AS ({measured(start)} UNION ALL {measured(ahead)})"


_FUSED = """SELECT j.traj_id, j.seq, round(px, 3) + 0e0 x, round(py, 3) + 0e0 y, round(vx, 3) + 0e0 v_e, round(vy, 3) + 0e0 v_n, f quality_score, f0 >= 0.35e0 AND (trusted OR j.o_x IS NOT NULL) trusted{reason}
 FROM (SELECT *, round(f0, 3) + 0e0 f FROM (SELECT *, CASE WHEN o_x IS NOT NULL THEN greatest(0e0, least(1e0, 0.6e0 * quality_score + 0.4e0 * coalesce(n_quality, 1e0))) ELSE quality_score END f0 FROM joined)) j JOIN kf USING (traj_id, seq)"""
ORACLES["ekf_fusion"] = f"WITH RECURSIVE {PTS}, {TRACK}, {kalman('pts')} " + _FUSED.format(reason=", CASE WHEN f0 >= 0.35e0 AND (trusted OR j.o_x IS NOT NULL) THEN 0 ELSE 40 END trust_reason")
ORACLES["ekf_sd_fusion"] = f"WITH RECURSIVE {PTS}, {SD}, {TRACK}, {kalman('sd')} " + _FUSED.format(reason="")
q("road_segments", SEGS, sql=f"SELECT seg_id, road_id, {', '.join(f'{r(c)} {c}' for c in ('x1', 'y1', 'x2', 'y2'))}, {r('heading', 5)} heading, {r('len')} len FROM segs")
_LANES = ", ".join(f"({i}, {float(o)}e0)" for i, o in enumerate(LANE_OFFSETS))
q(
    "virtual_lanes", VERT, "f AS (SELECT road_id, avg(lat) lat0, avg(lon) lon0 FROM verts GROUP BY 1)",
    f"w AS (SELECT road_id, k, lat0, lon0, {R}e0 * radians(lon - lon0) * cos(radians(lat0)) x, {R}e0 * radians(lat - lat0) y FROM verts JOIN f USING (road_id))",
    "n AS (SELECT *, coalesce(lead(x) OVER p, x) - coalesce(lag(x) OVER p, x) tx, coalesce(lead(y) OVER p, y) - coalesce(lag(y) OVER p, y) ty FROM w WINDOW p AS (PARTITION BY road_id ORDER BY k))",
    f"l(lane_id, offset_m) AS (VALUES {_LANES})",
    sql=f"SELECT road_id * 5 + lane_id road_id, lane_id, k::INTEGER point_id, {r(f'lat0 + degrees((y + tx / sqrt(tx * tx + ty * ty) * offset_m) / {R}e0)', 8)} lat, {r(f'lon0 + degrees((x - ty / sqrt(tx * tx + ty * ty) * offset_m) / ({R}e0 * cos(radians(lat0))))', 8)} lon, 5e0 h, offset_m FROM n, l",
)
_ENDS = "ends AS (SELECT seg_id, seg_id * 2 id, x1 x, y1 y FROM segs UNION ALL SELECT seg_id, seg_id * 2 + 1, x2, y2 FROM segs)"
q("segment_adjacency", SEGS, _ENDS, sql="SELECT DISTINCT a.seg_id, b.seg_id other FROM ends a JOIN ends b ON a.seg_id <> b.seg_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64")
_PAR = f"par AS (SELECT a.seg_id a, b.seg_id b FROM segs a JOIN segs b ON a.seg_id <> b.seg_id AND {ang('a.heading', 'b.heading')} <= radians(30e0) AND sqrt(pow((a.x1 + a.x2) / 2 - (b.x1 + b.x2) / 2, 2) + pow((a.y1 + a.y2) / 2 - (b.y1 + b.y2) / 2, 2)) <= 25)"
ORACLES["segment_clusters"] = f"WITH RECURSIVE {SEGS}, {_PAR}, reach AS (SELECT seg_id, seg_id other FROM segs UNION SELECT reach.seg_id, par.b FROM reach JOIN par ON par.a = reach.other) SELECT seg_id, min(other) AS \"cluster\" FROM reach GROUP BY 1"
# every end of the stand-in network lies within 3 m of the end that made its node and of no other, so the first end in reach is it
NODES = _ENDS + ", node_of AS (SELECT a.id, min(b.id) node FROM ends a JOIN ends b ON b.id <= a.id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 9 GROUP BY 1), nodes AS (SELECT seg_id, u.node u, v.node v FROM segs JOIN node_of u ON u.id = seg_id * 2 JOIN node_of v ON v.id = seg_id * 2 + 1)"
q("node_merge", SEGS, NODES, sql="SELECT seg_id, u, v FROM nodes")
EDGES = NODES + ", one AS (SELECT u, v, len FROM segs JOIN nodes USING (seg_id) WHERE u <> v), edges AS (SELECT src, dst, min(w) w FROM (SELECT u src, v dst, len w FROM one UNION ALL SELECT v, u, len FROM one) GROUP BY 1, 2)"
q("road_edges", SEGS, EDGES, sql=f"SELECT src, dst, {r('w')} w FROM edges")
# least distances, improved round by round until none changes
WAYS = """best(src, dst, d) USING KEY (src, dst) AS (SELECT src, dst, min(d) FROM (SELECT src, dst, w d FROM edges UNION ALL SELECT DISTINCT src, src, 0e0 FROM edges) GROUP BY 1, 2
 UNION SELECT n.src, n.dst, n.d FROM (SELECT b.src, e.dst, min(b.d + e.w) d FROM best b JOIN edges e ON e.src = b.dst GROUP BY 1, 2) n LEFT JOIN recurring.best o ON o.src = n.src AND o.dst = n.dst WHERE o.d IS NULL OR n.d < o.d - 1e-9)"""
ORACLES["shortest_paths"] = f"WITH RECURSIVE {SEGS}, {EDGES}, {WAYS} SELECT src, dst, {r('d', 2)} d FROM best"
q("near_segments", PTS, SEGS, PROJ, sql=f"SELECT traj_id, seq, seg_id, {r('obs_dist')} obs_dist FROM near WHERE obs_dist <= 35")
q("project_to_segment", PTS, SEGS, PROJ, sql=f"SELECT traj_id, seq, seg_id, {r('px')} px, {r('py')} py, {r('s')} s FROM near WHERE obs_dist <= 12")
_LD = ", ".join(f"sqrt(pow(x - (px - sin(heading) * ({o}e0)), 2) + pow(y - (py + cos(heading) * ({o}e0)), 2))" for o in LANE_OFFSETS)
q("project_to_lane", PTS, SEGS, PROJ, sql=f"SELECT traj_id, seq, seg_id, CASE WHEN least({_LD}) > 1e-9 THEN {r(f'least({_LD})')} ELSE 0e0 END lane_dist FROM near WHERE obs_dist <= 12")
q("hmm_candidates_topk", PTS, SEGS, CAND, sql=f"SELECT traj_id, seq, cand, {r('obs_dist')} obs_dist, {r('s')} s FROM cands")
EMIT = "hq AS (SELECT traj_id, seq, greatest(0.15e0, least(1e0, quality_score)) q, trusted FROM pts), em0 AS (SELECT c.*, NOT trusted OR q < 0.35e0 weak, q FROM cands c JOIN hq USING (traj_id, seq)), em AS (SELECT *, CASE WHEN weak THEN 22e0 ELSE 8e0 END / sqrt(q) emit_sigma FROM em0)"
q("hmm_emission", PTS, SEGS, CAND, EMIT, sql=f"SELECT traj_id, seq, cand, weak, {r('emit_sigma')} emit_sigma, {r('0.5e0 * pow(obs_dist / emit_sigma, 2)')} emit_cost FROM em")
STEPPED = "ob AS (SELECT *, greatest(0e0, least(200e0, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)))) step, lag(seq) OVER w before_, lag(chain_id) OVER w chain_before FROM ch WINDOW w AS (PARTITION BY traj_id ORDER BY seq))"
_WAYS = "least(" + ", ".join(f"{a} + {b} + {d}.d" for a, p in (("p.s", "u"), ("p.len - p.s", "v")) for b, c in (("c.s", "u"), ("c.len - c.s", "v")) for d in (f"d{p}{c}",)) + ")"
_DIST = " ".join(f"LEFT JOIN best d{p}{c} ON d{p}{c}.src = p.{p} AND d{p}{c}.dst = c.{c}" for p in "uv" for c in "uv")
ROUTES = f"""cn AS (SELECT em.*, u, v, step, before_, chain_id, chain_before FROM em JOIN nodes USING (seg_id) JOIN (SELECT traj_id, seq, step, before_, chain_id, chain_before FROM ob) USING (traj_id, seq)),
 routes AS (SELECT c.traj_id, c.seq, c.chain_id, p.cand p_cand, c.cand, c.step, c.weak OR p.weak either_, CASE WHEN c.seg_id = p.seg_id THEN abs(c.s - p.s) ELSE {_WAYS} END route
 FROM cn c JOIN cn p ON p.traj_id = c.traj_id AND p.seq = c.before_ AND c.chain_id = c.chain_before {_DIST}),
 trans AS (SELECT *, coalesce(abs(route - CASE WHEN either_ THEN least(step, 35e0) ELSE step END) / CASE WHEN either_ THEN 30e0 ELSE 15e0 END, 1e6) trans_cost FROM routes)"""
_HMM = f"WITH RECURSIVE {PTS}, {SEGS}, {CAND}, {EMIT}, {CHAIN}, {STEPPED}, {EDGES}, {WAYS}, {ROUTES}"
ORACLES["hmm_route_distance"] = f"{_HMM} SELECT traj_id, seq, p_cand, cand, {r('route', 2)} route FROM routes"
ORACLES["hmm_transition"] = f"{_HMM} SELECT traj_id, seq, p_cand, cand, {r('trans_cost', 2)} trans_cost FROM trans"


def best_path(emission: str) -> str:
    """Through each chain, a point a round: forward the least cost of each candidate and the one it comes from, then back from the least last one."""
    return f"""at_ AS (SELECT traj_id, seq, chain_id, row_number() OVER (PARTITION BY traj_id, chain_id ORDER BY seq) rn, count(*) OVER (PARTITION BY traj_id, chain_id) n FROM ch),
 ec AS (SELECT em.*, chain_id, rn, n, {emission} emit_cost FROM em JOIN at_ USING (traj_id, seq)),
 fw AS (SELECT traj_id, chain_id, rn, seq, cand, emit_cost cost, CAST(NULL AS INTEGER) prev FROM ec WHERE rn = 1
 UNION ALL SELECT e.traj_id, e.chain_id, e.rn, e.seq, e.cand, min(f.cost + t.trans_cost) + any_value(e.emit_cost), arg_min(f.cand, (f.cost + t.trans_cost, f.cand))
 FROM fw f JOIN ec e ON e.traj_id = f.traj_id AND e.chain_id = f.chain_id AND e.rn = f.rn + 1 JOIN trans t ON t.traj_id = e.traj_id AND t.seq = e.seq AND t.p_cand = f.cand AND t.cand = e.cand GROUP BY ALL),
 ends_ AS (SELECT traj_id, chain_id, max(rn) rn FROM fw GROUP BY 1, 2),
 bw AS (SELECT f.traj_id, f.chain_id, f.rn, f.seq, f.cand, f.prev FROM fw f JOIN ends_ USING (traj_id, chain_id, rn) QUALIFY row_number() OVER (PARTITION BY f.traj_id, f.chain_id ORDER BY f.cost, f.cand) = 1
 UNION ALL SELECT f.traj_id, f.chain_id, f.rn, f.seq, f.cand, f.prev FROM bw b JOIN fw f ON f.traj_id = b.traj_id AND f.chain_id = b.chain_id AND f.rn = b.rn - 1 AND f.cand = b.prev)"""


_EC = "0.5e0 * pow(obs_dist / emit_sigma, 2)"
ORACLES["hmm_viterbi"] = f"{_HMM}, {best_path(_EC)} SELECT traj_id, seq, chain_id, cand, {r('cost', 2)} cost FROM bw JOIN (SELECT traj_id, seq, min(cost) cost FROM fw GROUP BY 1, 2) USING (traj_id, seq)"
_LAT, _LON = r(f"30e0 + degrees(py / {R}e0)", 8), r(f"120e0 + degrees(px / ({R}e0 * cos(radians(30e0))))", 8)
_PLAIN_EMIT = "em AS (SELECT *, FALSE weak, 8e0 emit_sigma FROM cands)"
ORACLES["hmm_matched"] = (
    f"WITH RECURSIVE {PTS}, {SEGS}, {CAND}, {_PLAIN_EMIT}, {CHAIN}, {STEPPED}, {EDGES}, {WAYS}, {ROUTES}, {best_path(_EC)} "
    f"SELECT traj_id, seq, seg_id, {_LAT} lat, {_LON} lon, {r(f'greatest(0.05e0, least(1e0, exp(-({_EC}))))')} quality_score, obs_dist < 35 trusted FROM bw JOIN em USING (traj_id, seq, cand)"
)
_SD_PTS = "pts AS (SELECT * FROM sd)"
ORACLES["hmm_sd_matched"] = (
    f"WITH RECURSIVE {PTS.replace('pts AS', 'pts0 AS')}, {SD.replace('FROM pts', 'FROM pts0')}, {_SD_PTS}, {SEGS}, {CAND}, {EMIT}, {CHAIN}, {STEPPED}, {EDGES}, {WAYS}, {ROUTES}, {best_path(_EC)} "
    f"SELECT bw.traj_id, bw.seq, em.seg_id, {_LAT} lat, {_LON} lon, {r('pts.quality_score')} quality_score, pts.trusted FROM bw JOIN em USING (traj_id, seq, cand) JOIN pts USING (traj_id, seq)"
).replace("em.seg_id, round(30e0 + degrees(py", "em.seg_id, round(30e0 + degrees(em.py").replace("degrees(px /", "degrees(em.px /")
VOTE = f"""head AS (SELECT hd.*, coalesce(CASE WHEN sqrt(e * e + n * n) > 0.35e0 THEN atan2(n, e) END, obs_heading) hh FROM hd JOIN (SELECT traj_id tj, seq sq,
 CASE WHEN ps BETWEEN 0.05e0 AND 60 THEN pha_e WHEN ds <= 60 THEN vel_e END e, CASE WHEN ps BETWEEN 0.05e0 AND 60 THEN pha_n WHEN ds <= 60 THEN vel_n END n FROM sp) ON tj = traj_id AND sq = seq),
 num AS (SELECT *, row_number() OVER {LAG} rn, count(*) OVER (PARTITION BY traj_id) cn FROM head),
 fr AS (SELECT a.traj_id, a.seq at_seq, b.seq, b.x, b.y, b.hh, least(5, a.cn - a.rn + 1) n FROM num a JOIN num b ON a.traj_id = b.traj_id AND b.rn BETWEEN a.rn AND a.rn + 4),
 ask AS (SELECT DISTINCT fr.traj_id, at_seq, seg_id FROM fr JOIN near ON near.traj_id = fr.traj_id AND near.seq = fr.seq AND obs_dist <= 35 + 7),
 sc0 AS (SELECT fr.*, segs.seg_id, heading, x1, y1, x2, y2, greatest(0e0, least(1e0, ((fr.x - x1) * (x2 - x1) + (fr.y - y1) * (y2 - y1)) / (len * len))) t FROM fr JOIN ask USING (traj_id, at_seq) JOIN segs ON segs.seg_id = ask.seg_id),
 sc AS (SELECT *, x1 + (x2 - x1) * t px, y1 + (y2 - y1) * t py FROM sc0),
 sv AS (SELECT traj_id, at_seq, seg_id, sum(0.7e0 * {_DI.format(f'least({_LD})')} + 0.3e0 * {_HI.format('CASE WHEN hh IS NULL THEN 0e0 ELSE least(' + ang('hh', 'heading') + ', ' + ang('hh', 'heading + pi()') + ') END')}) / max(n) score FROM sc GROUP BY 1, 2, 3),
 top AS (SELECT *, row_number() OVER (PARTITION BY traj_id, at_seq ORDER BY score DESC, seg_id) rk FROM sv)"""
PROJ_WIDE = PROJ.replace("40", "45")
q("smp_vote", PTS, SPEED, HEAD, SEGS, PROJ_WIDE, VOTE, sql=f"SELECT traj_id, at_seq seq, seg_id, {r('score', 5)} score FROM top WHERE rk = 1")
_F = "printf('%.10f', {})"
_STATE = ", ".join(f"coalesce({_F.format(x)}, 'nan')" for x in (r("lat", 8), r("lon", 8), "h", r("x"), r("y"), "vel_e", "vel_n", "0e0", "quality_score"))
q("car_points_format", PTS, sql=f"SELECT traj_id, seq, concat_ws(' ', ts_ms::VARCHAR, {_STATE}, CASE WHEN trusted THEN '1' ELSE '0' END, '0') line FROM pts")
q("track_parse", PTS, sql=f"SELECT traj_id, seq, ts_ms, {r('lat', 8)} lat, {r('lon', 8)} lon, {r('x')} x, quality_score, trusted, 0 trust_reason FROM pts")
q("coor_parse", OBS, sql=f"SELECT traj_id, seq, CAST(round((2252 * 604800e0 + seq + 315964800e0) * 1000e0) AS BIGINT) ts_ms, {r('lat', 8)} lat, {r('lon', 8)} lon, h, 2 n_extra FROM obs WHERE seq % 50 <> 0")
q("truth_parse", TRUTH, sql=f"SELECT traj_id, 'GPS' data_type, ts_ms, {r('lat', 8)} lat, {r('lon', 8)} lon, NULL::DOUBLE h, 0.5e0 radius FROM truth WHERE ts_ms % 7 <> 0")
q("road_matched_parse", PTS, sql=f"SELECT traj_id, seq, CASE WHEN seq % 2 = 0 THEN 'GPS_matched' ELSE 'GPS_inv' END data_type, ts_ms, {r('lat', 8)} lat, {r('lon', 8)} lon, CASE WHEN seq % 2 = 0 THEN 0.5e0 ELSE 0.75e0 END radius FROM pts")
q("kml_parse", VERT, sql=f"SELECT road_id, k::INTEGER point_id, {r('lat', 8)} lat, {r('lon', 8)} lon, 5e0 h FROM verts")

_F8 = "coalesce(printf('%.8f', {}), 'nan')"
q("hmm_lines_format", PTS, sql=f"SELECT traj_id, seq, concat_ws(chr(9), ts_ms::VARCHAR, {_F8.format(r('lat', 8))}, {_F8.format(r('lon', 8))}, {_F8.format('h')}) line FROM pts")
_FLAG = "CASE WHEN {} THEN '1' ELSE '0' END"
_EVQ = EVAL.replace("NOT trusted OR", "trusted, quality_score, ts_ms, NOT trusted OR")
q(
    "evaluation_format", PTS, SD, TRUTH, asof("truth", "sd", ("lat", "lon"), 2000, True), _EVQ,
    sql=f"SELECT traj_id, seq, concat_ws(chr(9), seq::VARCHAR, ts_ms::VARCHAR, {_F8.format(r('error_m'))}, {_F8.format(r('error_m'))}, {_FLAG.format('error_m > 5')}, {_FLAG.format('sd_abnormal')}, {_FLAG.format('trusted')}, {_F8.format(r('quality_score'))}) line FROM ev",
)
_LANE_SQL = ORACLES["virtual_lanes"].replace(", 8) + 0e0 lat", ", 7) + 0e0 lat").replace(", 8) + 0e0 lon", ", 7) + 0e0 lon")
ORACLES["lane_lines_format"] = f"SELECT road_id, point_id, concat_ws(' ', road_id::VARCHAR, lane_id::VARCHAR, point_id::VARCHAR, {', '.join(_F.format(c) for c in ('lat', 'lon', 'h', 'offset_m'))}) line FROM ({_LANE_SQL})"
_KML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n<name>Matched trajectory</name>\n<Style id="line"><LineStyle><color>ff00ff00</color>'
    '<width>4</width></LineStyle></Style>\n<Placemark>\n<styleUrl>#line</styleUrl>\n<LineString><tessellate>1</tessellate><coordinates>\n'
)
_KML_TAIL = "\n</coordinates></LineString>\n</Placemark>\n</Document>\n</kml>"
q("track_kml_format", PTS, f"doc AS (SELECT traj_id, '{_KML_HEAD}' || string_agg(concat_ws(',', {_F.format(r('lon', 8))}, {_F.format(r('lat', 8))}, {_F.format('h')}), chr(10) ORDER BY seq) || '{_KML_TAIL}' line FROM pts GROUP BY 1)", sql="SELECT traj_id, sha256(line) sha256, length(line) n FROM doc")
q(
    "hmm_debug_format", OBS,
    sql=f"SELECT traj_id, seq, concat_ws(chr(9), ts_ms::VARCHAR, {_F8.format(r('lat', 8))}, {_F8.format(r('lon', 8))}, seq::VARCHAR, {_F8.format('seq * 0.5e0')}, {_F8.format('seq * 0.25e0')}, '8.00000000', {_FLAG.format('trusted')}, {_F8.format('quality_score')}, {_FLAG.format('seq % 2 = 0')}) line FROM obs WHERE seq % 5 <> 0",
)
q("output_names", sql="SELECT source, m sd_match, n sd_noise, 'ekf_' || source || CASE WHEN m THEN '_sdmatch' ELSE '_normalmatch' END || CASE WHEN n THEN '_sdnoise' ELSE '_fixednoise' END || '_points.txt' output, '/out/' || source || '_debug.txt' debug FROM (VALUES ('mm'), ('hmm')) a(source), (VALUES (TRUE), (FALSE)) b(m), (VALUES (TRUE), (FALSE)) c(n)")
q("sd_modes", sql="SELECT * FROM (VALUES (0, 'off'), (1, 'three_sigma'), (2, 'prediction')) m(mode, name)")
q("valid_rows", OBS, TRACK, sql="SELECT (SELECT count(*) FROM obs) places, (SELECT count(*) FROM obs WHERE vel_e IS NOT NULL AND vel_n IS NOT NULL) speeds, (SELECT count(*) FROM track WHERE x IS NOT NULL) track_places")
q("car_points_xy", PTS, sql=f"SELECT traj_id, seq, CASE WHEN seq % 2 = 0 THEN 1.5e0 ELSE {r('x')} END x, {r('y')} y FROM pts")
q("endpoint_distances", SEGS, _ENDS, sql=f"SELECT a.seg_id, b.seg_id other, {r('min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y))')} d2 FROM ends a JOIN ends b ON a.seg_id <> b.seg_id GROUP BY 1, 2 HAVING min((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 64")
q(
    "near_intersection", PTS, SEGS, _ENDS, PROJ, "beside AS (SELECT DISTINCT a.seg_id FROM ends a JOIN ends b ON a.seg_id <> b.seg_id AND (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 64)",
    sql="SELECT traj_id, seq, seg_id, least(sqrt(pow(x - x1, 2) + pow(y - y1, 2)), sqrt(pow(x - x2, 2) + pow(y - y2, 2))) <= 30 AND seg_id IN (SELECT seg_id FROM beside) near_node FROM near WHERE obs_dist <= 12",
)


def lanes_sql(speed_detection: bool) -> str:
    """The cheapest eight lanes of each point in the state `road`."""
    w = [float(x) for x in STATES["road"]]
    lanes = ", ".join(f"({i}, {float(o)}e0)" for i, o in enumerate(LANE_OFFSETS))
    sm = lambda n: (lambda x: f"({x}) * ({x}) * (3e0 - 2e0 * ({x}))")(f"greatest(0e0, least(1e0, (res - 5e0) / {n}e0))")
    cost = [f"{w[0]}e0 * dobs * dobs", f"coalesce({w[2]}e0 * mv, 0e0)"]
    if speed_detection:
        ql, grade = f"(1e0 - 0.80e0 * ({sm(7)}))", f"({sm(15)})"
        cost = [
            f"{w[0]}e0 * greatest(0.30e0, 0.15e0 + 0.85e0 * {ql}) * dobs * dobs", f"{w[1]}e0 * (1e0 + 0.80e0 * {grade} + 0.60e0 * (1e0 - {ql})) * (pow(lx - drx, 2) + pow(ly - dry, 2))",
            f"{w[2]}e0 * (1e0 + 0.45e0 * {grade} + 0.45e0 * (1e0 - {ql})) * coalesce(mv, 0e0)", f"CASE WHEN still OR sp < 0.80e0 OR speed_e IS NULL THEN 0e0 ELSE (1e0 - cos(least({ang('atan2(speed_n, speed_e)', 'heading')}, {ang('atan2(speed_n, speed_e)', 'heading + pi()')}))) * {w[4]}e0 END",
        ]
    turn = f"CASE WHEN mv > 1 THEN least({ang('atan2(ly - y0, lx - x0)', 'heading')}, {ang('atan2(ly - y0, lx - x0)', 'heading + pi()')}) ELSE 0e0 END"
    cost.append(f"CASE WHEN still THEN 0e0 ELSE (1e0 - cos({turn})) * {w[3]}e0 END")
    reach = w[5]
    return f"""WITH {PTS}, {SPEED.replace("WHEN ds BETWEEN 0.05e0 AND 60", "WHEN ds <= 60")}, {SEGS}, pv AS (SELECT *, lag(x) OVER w x0, lag(y) OVER w y0, lag(speed_e) OVER w e0_, lag(speed_n) OVER w n0_, (ts_ms - lag(ts_ms) OVER w) / 1000e0 dt FROM spd WINDOW w AS {LAG}),
 dr AS (SELECT *, coalesce(x0 + e0_ * dt, x) drx, coalesce(y0 + n0_ * dt, y) dry, sqrt(speed_e * speed_e + speed_n * speed_n) sp FROM pv),
 rw AS (SELECT d.*, seg_id, heading, x1, y1, x2, y2, greatest(0e0, least(1e0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (len * len))) t FROM dr d JOIN segs
 ON x BETWEEN least(x1, x2) - {reach + 5} AND greatest(x1, x2) + {reach + 5} AND y BETWEEN least(y1, y2) - {reach + 5} AND greatest(y1, y2) + {reach + 5}),
 ln AS (SELECT *, x1 + (x2 - x1) * t - sin(heading) * off lx, y1 + (y2 - y1) * t + cos(heading) * off ly FROM (SELECT * FROM rw WHERE sqrt(pow(x - x1 - (x2 - x1) * t, 2) + pow(y - y1 - (y2 - y1) * t, 2)) <= {reach}), (VALUES {lanes}) l(lane, off)),
 ds AS (SELECT *, sqrt(pow(lx - x, 2) + pow(ly - y, 2)) dobs, pow(lx - x0, 2) + pow(ly - y0, 2) mv, sqrt(pow(x - drx, 2) + pow(y - dry, 2)) res, coalesce(sp <= 0.35e0, FALSE) still FROM ln),
 cs AS (SELECT *, {' + '.join(cost)} cost FROM ds WHERE dobs <= 50)
 SELECT traj_id, seq, cand, {r("cost", 4)} emit_cost FROM (SELECT *, CAST(row_number() OVER (PARTITION BY traj_id, seq ORDER BY cost, seg_id, lane) - 1 AS INTEGER) cand FROM cs) WHERE cand < 8"""


ORACLES["lane_candidates"], ORACLES["lane_candidates_sd"] = lanes_sql(False), lanes_sql(True)
