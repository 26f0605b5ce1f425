"""The registered queries of the trajectory engine, one per operator family, over the stand-in trajectories of `surrogate`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, quality
from ..functions.constants import LANE_OFFSETS
from ..operators import asof, ekf, hmm, lane_candidates as lc, observations as obs, roads, speed_detection as sd, state_machine as sm
from ..sources import sinks, text
from . import surrogate as s
from .registry import QUERIES


def query(f):
    QUERIES[f.__name__] = f
    return f


def r(c: str | Column, digits: int = 3) -> Column:
    """Rounded, without negative zero."""
    name = c if isinstance(c, str) else None
    out = F.round(F.col(c) if name else c, digits) + F.lit(0.0)
    return out.alias(name) if name else out


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.with_frame(s.observations(spark, sf_dir), s.REF)


def cars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return obs.car_points(s.observations(spark, sf_dir), s.REF)


def network(spark: SparkSession) -> DataFrame:
    return roads.segments(s.roads(spark), s.REF)


KEY = ("traj_id", "seq")


@query
def sd_anomaly_counts(spark, sf_dir):
    found = sd.prediction(cars(spark, sf_dir))
    return found.groupBy("traj_id").agg(F.count("*").alias("n"), F.count_if(~F.col("trusted")).alias("n_untrusted"), F.count_if(F.col("quality_score") < 0.35).alias("n_low"))


@query
def gps_time_ms(spark, sf_dir):
    o = s.observations(spark, sf_dir)
    since = F.col("ts_ms") / F.lit(1000.0) - 315964800.0
    week = F.floor(since / 604800.0)
    return o.select(*KEY, geo.gps_time_ms(week, since - week * 604800.0).alias("ts_ms"))


@query
def time_window_filter(spark, sf_dir):
    return obs.time_window_filter(s.observations(spark, sf_dir)).select(*KEY, "ts_ms")


@query
def time_window_rejects(spark, sf_dir):
    return obs.time_window_rejects(s.observations(spark, sf_dir))


@query
def time_window_exclude_table(spark, sf_dir):
    from ..functions.constants import EXCLUDE_WINDOWS

    windows = spark.createDataFrame(list(EXCLUDE_WINDOWS), "low long, high long")
    return obs.exclude_by_table(s.observations(spark, sf_dir), windows).select(*KEY, "ts_ms")


@query
def local_ref(spark, sf_dir):
    return obs.local_ref(s.observations(spark, sf_dir)).select("traj_id", r("lat0", 8), r("lon0", 8), r("cos0", 8))


@query
def ll_to_xy(spark, sf_dir):
    return points(spark, sf_dir).select(*KEY, r("x"), r("y"))


@query
def xy_to_ll(spark, sf_dir):
    p = points(spark, sf_dir)
    lat0, lon0 = (F.lit(x) for x in s.REF)
    return p.select(*KEY, r(geo.to_lat(F.col("y") + 1.5, lat0), 8).alias("lat"), r(geo.to_lon(F.col("x") - 2.5, lat0, lon0), 8).alias("lon"))


@query
def haversine_step(spark, sf_dir):
    bare = s.observations(spark, sf_dir).withColumns({"x": F.lit(None).cast("double"), "y": F.lit(None).cast("double")})
    return obs.steps(bare).select(*KEY, r("dt_s"), r("step_m"))


@query
def planar_step(spark, sf_dir):
    return obs.steps(points(spark, sf_dir)).select(*KEY, r("dt_s"), r("step_m"))


@query
def angle_diff(spark, sf_dir):
    a, b = F.col("seq") * F.lit(0.37) - 40.0, F.col("seq") * F.lit(0.11)
    return s.observations(spark, sf_dir).select(*KEY, r(geo.angle_diff(a, b), 6).alias("diff"))


@query
def heading_bidirectional(spark, sf_dir):
    a, b = F.col("seq") * F.lit(0.37) - 40.0, F.col("seq") * F.lit(0.11)
    return s.observations(spark, sf_dir).select(*KEY, r(geo.heading_diff_both_ways(a, b), 6).alias("diff"), r(geo.angle_diff(a, geo.facing(b, a)), 6).alias("faced"))


@query
def paper_indices(spark, sf_dir):
    d, a = F.col("seq") * F.lit(0.2), F.col("seq") * F.lit(0.006)
    return s.observations(spark, sf_dir).select(*KEY, r(quality.distance_index(d), 6).alias("distance_index"), r(quality.heading_index(a), 6).alias("heading_index"))


@query
def valid_speed_en(spark, sf_dir):
    return obs.raw_speed(s.observations(spark, sf_dir), 0.05).select(*KEY, r("speed_e", 6), r("speed_n", 6), r("speed", 6), r("speed_heading", 6))


@query
def sd_prediction(spark, sf_dir):
    return sd.detect(cars(spark, sf_dir), 2).select(*KEY, r("residual_m"), "trusted", "trust_reason", r("quality_score"))


@query
def sd_three_sigma(spark, sf_dir):
    return sd.detect(cars(spark, sf_dir), 1).select(*KEY, r("speed_mps"), "trusted", "trust_reason", r("quality_score"))


@query
def sd_off(spark, sf_dir):
    return sd.detect(cars(spark, sf_dir), 0).select(*KEY, "trusted", "trust_reason", "quality_score")


@query
def sd_quality_noise(spark, sf_dir):
    found = sd.prediction(cars(spark, sf_dir))
    res = F.coalesce("residual_m", F.lit(0.0))
    return found.select(
        *KEY, r(quality.noise_scale(F.col("quality_score"), F.col("trusted"))).alias("scale"), r(quality.smooth_quality(res, 5.0, 12.0, 0.08)).alias("smooth_quality"), r(quality.severity(res, 5.0, 20.0)).alias("severity")
    )


@query
def chain_split(spark, sf_dir):
    return obs.chains(s.observations(spark, sf_dir)).groupBy("traj_id", "chain_id").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count("*").alias("n"))


@query
def obs_heading(spark, sf_dir):
    return obs.observation_heading(points(spark, sf_dir)).select(*KEY, r("obs_heading", 5))


@query
def truth_asof_nearest(spark, sf_dir):
    found = asof.nearest(s.observations(spark, sf_dir).select(*KEY, "ts_ms"), s.truth(spark, sf_dir), ("lat", "lon"), 2000, "later")
    return found.select(*KEY, "m_ts", r("lat", 8), r("lon", 8))


@query
def sd_eval_rows(spark, sf_dir):
    rows = sd.evaluation_rows(sd.prediction(cars(spark, sf_dir)), s.truth(spark, sf_dir))
    return rows.select(*KEY, r("error_m"), "truth_abnormal", "sd_abnormal")


@query
def sd_eval_metrics(spark, sf_dir):
    m = sd.evaluate(sd.prediction(cars(spark, sf_dir)), s.truth(spark, sf_dir))
    return m.select("n", "tp", "fp", "fn", "tn", r("rmse_m"), r("max_m"), r("recall", 6), r("precision", 6), r("f1", 6), r("abnormal_share", 6))


@query
def matched_asof_nearest(spark, sf_dir):
    found = asof.nearest(s.observations(spark, sf_dir).select(*KEY, "ts_ms"), s.track(spark, sf_dir), ("x", "quality_score"), 1000, "earlier")
    return found.select(*KEY, "m_ts", r("x"), r("quality_score"))


@query
def matched_asof_interpolate(spark, sf_dir):
    found = asof.matched(s.observations(spark, sf_dir).select(*KEY, "ts_ms"), s.track(spark, sf_dir))
    return found.select(*KEY, "m_ts", r("o_x"), r("o_y"), r("o_quality"), "o_trusted", r("n_quality"))


@query
def road_segments(spark, sf_dir):
    return network(spark).select("seg_id", "road_id", *(r(c) for c in ("x1", "y1", "x2", "y2")), r("heading", 5), r("len"))


@query
def virtual_lanes(spark, sf_dir):
    return roads.lane_points(roads.virtual_lanes(s.roads(spark))).select("road_id", "lane_id", "point_id", r("lat", 8), r("lon", 8), "h", "offset_m")


@query
def segment_adjacency(spark, sf_dir):
    return roads.adjacency(network(spark))


@query
def segment_clusters(spark, sf_dir):
    return roads.clusters(network(spark))


@query
def node_merge(spark, sf_dir):
    return roads.merged_nodes(network(spark))


@query
def road_edges(spark, sf_dir):
    net = network(spark)
    return roads.edges(net, roads.merged_nodes(net)).select("src", "dst", r("w"))


@query
def shortest_paths(spark, sf_dir):
    net = network(spark)
    e = roads.edges(net, roads.merged_nodes(net))
    return roads.shortest_paths(e, e.select("src")).select("src", "dst", r("d", 2))


@query
def near_segments(spark, sf_dir):
    return roads.grid_join(points(spark, sf_dir).select(*KEY, "x", "y"), network(spark), 35.0).select(*KEY, "seg_id", r("obs_dist"))


@query
def project_to_segment(spark, sf_dir):
    return roads.grid_join(points(spark, sf_dir).select(*KEY, "x", "y"), network(spark), 12.0).select(*KEY, "seg_id", r("px"), r("py"), r("s"))


@query
def project_to_lane(spark, sf_dir):
    near = roads.grid_join(points(spark, sf_dir).select(*KEY, "x", "y"), network(spark), 12.0)
    lanes = F.array(*(F.struct(geo.distance(F.col("x"), F.col("y"), *geo.lane_point(F.col("px"), F.col("py"), F.col("heading"), F.lit(k))).alias("d"), F.lit(i).alias("lane")) for i, k in enumerate(LANE_OFFSETS)))
    return near.withColumn("b", F.array_min(lanes)).select(*KEY, "seg_id", F.when(F.col("b.d") > 1e-9, r(F.col("b.d"))).otherwise(0.0).alias("lane_dist"))


@query
def hmm_candidates_topk(spark, sf_dir):
    return hmm.candidates(points(spark, sf_dir), network(spark)).select(*KEY, "cand", r("obs_dist"), r("s"))


@query
def hmm_emission(spark, sf_dir):
    p = points(spark, sf_dir)
    return hmm.emissions(p, hmm.candidates(p, network(spark)), True).select(*KEY, "cand", "weak", r("emit_sigma"), r("emit_cost"))


def _routes(spark, sf_dir) -> DataFrame:
    p, net = points(spark, sf_dir), network(spark)
    nodes = roads.merged_nodes(net)
    e = roads.edges(net, nodes)
    emitted = hmm.emissions(p, hmm.candidates(p, net), True)
    pairs = hmm.candidate_pairs(emitted, hmm.observation_steps(p), net, nodes)
    return hmm.route_distances(pairs, roads.wanted_paths(e, hmm.wanted_ends(hmm.segment_pairs(pairs))))


@query
def hmm_route_distance(spark, sf_dir):
    return _routes(spark, sf_dir).select(*KEY, "p_cand", "cand", r("route", 2))


@query
def hmm_transition(spark, sf_dir):
    return hmm.transition_costs(_routes(spark, sf_dir)).select(*KEY, "p_cand", "cand", r("trans_cost", 2))


@query
def hmm_viterbi(spark, sf_dir):
    p, net = points(spark, sf_dir), network(spark)
    emitted = hmm.emissions(p, hmm.candidates(p, net), True)
    return hmm.viterbi(emitted, hmm.observation_steps(p), hmm.transition_costs(_routes(spark, sf_dir))).select(*KEY, "chain_id", "cand", r("cost", 2))


def _matched(spark, sf_dir, speed_detection: bool) -> DataFrame:
    p = points(spark, sf_dir)
    if speed_detection:
        found = sd.prediction(p.withColumns({"v_e": F.col("vel_e"), "v_n": F.col("vel_n")}))
        p = found.drop("v_e", "v_n", "residual_m")
    m = hmm.match(p, network(spark), speed_detection)
    lat0, lon0 = (F.lit(x) for x in s.REF)
    return m.select(*KEY, "seg_id", r(geo.to_lat(F.col("my"), lat0), 8).alias("lat"), r(geo.to_lon(F.col("mx"), lat0, lon0), 8).alias("lon"), r("quality_score"), "trusted")


@query
def hmm_matched(spark, sf_dir):
    return _matched(spark, sf_dir, False)


@query
def hmm_sd_matched(spark, sf_dir):
    return _matched(spark, sf_dir, True)


@query
def smp_vote(spark, sf_dir):
    return sm.segment_votes(points(spark, sf_dir), network(spark)).select(*KEY, "seg_id", r("score", 5))


@query
def mm_matched(spark, sf_dir):
    return sm.match(points(spark, sf_dir), network(spark)).select(*KEY, "seg_id", r("mx"), r("my"))


@query
def mm_sd_matched(spark, sf_dir):
    return sm.match(points(spark, sf_dir), network(spark), True).select(*KEY, "seg_id", r("mx"), r("my"), "trusted", "trust_reason", r("quality_score"))


@query
def ekf_fusion(spark, sf_dir):
    return ekf.fuse(points(spark, sf_dir), s.track(spark, sf_dir), s.REF).select(*KEY, r("x"), r("y"), r("v_e"), r("v_n"), r("quality_score"), "trusted", "trust_reason")


@query
def ekf_sd_fusion(spark, sf_dir):
    p = points(spark, sf_dir)
    scored = sd.prediction(p.withColumns({"v_e": F.col("vel_e"), "v_n": F.col("vel_n")})).drop("v_e", "v_n")
    return ekf.fuse(scored, s.track(spark, sf_dir), s.REF).select(*KEY, r("x"), r("y"), r("v_e"), r("v_n"), r("quality_score"), "trusted")


@query
def car_points_format(spark, sf_dir):
    short = cars(spark, sf_dir).withColumns({"x": r("x"), "y": r("y"), "lat": r("lat", 8), "lon": r("lon", 8)})
    return sinks.state_lines(short)


@query
def track_parse(spark, sf_dir):
    lines = car_points_format(spark, sf_dir).withColumnRenamed("line", "value")
    return text.track(lines).select(*KEY, "ts_ms", r("lat", 8), r("lon", 8), r("x"), "quality_score", "trusted", "trust_reason")


@query
def coor_parse(spark, sf_dir):
    o = s.observations(spark, sf_dir)
    cols = [F.lit("0")] * 6 + [F.lit("2252"), F.col("seq").cast("string")] + [F.lit("1")] * 2 + [F.format_string("%.8f", c) for c in ("lat", "lon", "h")] + [F.lit("0.5")] * (20 + 2)
    cut = F.when(F.col("seq") % 50 == 0, F.lit("x 1")).otherwise(F.lit(""))  # a bad token leaves too few numbers
    lines = o.select(*KEY, F.concat(F.concat_ws(" ", *cols[:20]), F.lit(" "), cut, F.lit(" "), F.concat_ws("  ", *cols[20:])).alias("value"))
    return text.observations(lines).select(*KEY, "ts_ms", r("lat", 8), r("lon", 8), "h", F.size("extra").alias("n_extra"))


@query
def truth_parse(spark, sf_dir):
    t = s.truth(spark, sf_dir)
    stamp = F.when(F.col("ts_ms") % 7 == 0, F.lit("bad")).otherwise(F.col("ts_ms").cast("string"))
    lines = t.select("traj_id", F.concat(F.lit("{'dataType':'GPS','timestamp':"), stamp, F.lit(",'x':"), F.format_string("%.8f", "lon"), F.lit(", 'y':"), F.format_string("%.8f", "lat"), F.lit(",'redius':0.5}")).alias("value"))
    return text.truth(lines).select("traj_id", "data_type", "ts_ms", r("lat", 8), r("lon", 8), "h", "radius")


@query
def road_matched_parse(spark, sf_dir):
    short = cars(spark, sf_dir).withColumns({"lat": r("lat", 8), "lon": r("lon", 8)})
    lines = sinks.matched_lines(short).withColumn("value", F.when(F.col("seq") % 2 == 0, F.col("line")).otherwise(F.expr("substr(line, 13, length(line) - 16)"))).drop("line")
    return text.road_matched(lines, "GPS_inv", 0.75).select(*KEY, "data_type", "ts_ms", r("lat", 8), r("lon", 8), "radius")


@query
def kml_parse(spark, sf_dir):
    whole = sinks.kml(s.roads(spark)).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("road_id", "line"))), lambda x: x["line"]), "\n").alias("value")).select(F.lit("f").alias("file"), "value")
    return text.kml_roads(whole).select(F.col("road_id").cast("long").alias("road_id"), F.posexplode("points").alias("point_id", "p")).select("road_id", "point_id", r("p.lat", 8).alias("lat"), r("p.lon", 8).alias("lon"), F.col("p.h").alias("h"))




@query
def hmm_lines_format(spark, sf_dir):
    return sinks.hmm_lines(cars(spark, sf_dir).withColumns({"lat": r("lat", 8), "lon": r("lon", 8)}))


@query
def evaluation_format(spark, sf_dir):
    rows = sd.evaluation_rows(sd.prediction(cars(spark, sf_dir)), s.truth(spark, sf_dir))
    return sinks.evaluation_lines(rows.withColumns({"error_m": r("error_m"), "quality_score": r("quality_score")}))


@query
def lane_lines_format(spark, sf_dir):
    short = roads.lane_points(roads.virtual_lanes(s.roads(spark))).withColumns({"lat": r("lat", 7), "lon": r("lon", 7)})
    return sinks.lane_lines(short)


@query
def track_kml_format(spark, sf_dir):
    return sinks.track_kml(cars(spark, sf_dir).withColumns({"lat": r("lat", 8), "lon": r("lon", 8)})).select("traj_id", F.sha2("line", 256).alias("sha256"), F.length("line").cast("long").alias("n"))


@query
def hmm_debug_format(spark, sf_dir):
    o = s.observations(spark, sf_dir)
    made = {"lat": r("lat", 8), "lon": r("lon", 8), "seg_id": F.when(F.col("seq") % 5 != 0, F.col("seq")), "obs_dist": F.col("seq") * F.lit(0.5), "emit_cost": F.col("seq") * F.lit(0.25), "emit_sigma": F.lit(8.0), "weak": F.col("seq") % 2 == 0}
    return sinks.hmm_debug_lines(o.withColumns(made))


@query
def output_names(spark, sf_dir):
    flags = [(source, match, noise) for source in ("mm", "hmm") for match in (False, True) for noise in (False, True)]
    rows = [(source, match, noise, sinks.ekf_output(source, match, noise), sinks.sibling(f"/out/{source}.txt", "_debug")) for source, match, noise in flags]
    return spark.createDataFrame(rows, "source string, sd_match boolean, sd_noise boolean, output string, debug string")


@query
def sd_modes(spark, sf_dir):
    return spark.createDataFrame(list(sd.MODES.items()), "mode long, name string")


@query
def valid_rows(spark, sf_dir):
    o, t = s.observations(spark, sf_dir), s.track(spark, sf_dir)
    n = o.agg(F.count_if(geo.is_finite("lat") & geo.is_finite("lon")).alias("places"), F.count_if(geo.is_finite("vel_e") & geo.is_finite("vel_n")).alias("speeds"))
    return n.join(t.agg(F.count_if(geo.is_finite("x") & geo.is_finite("y")).alias("track_places")))


@query
def car_points_xy(spark, sf_dir):
    p = points(spark, sf_dir)
    return obs.fill_xy(p.withColumn("x", F.when(F.col("seq") % 2 == 0, F.lit(1.5))), s.REF).select(*KEY, r("x"), r("y"))


@query
def endpoint_distances(spark, sf_dir):
    net = network(spark)
    ends = ("x1", "y1", "x2", "y2")
    pairs = roads.adjacency(net).join(net.select("seg_id", *(F.col(c).alias(f"a{c}") for c in ends)), "seg_id").join(net.select(F.col("seg_id").alias("other"), *(F.col(c).alias(f"b{c}") for c in ends)), "other")
    return pairs.select("seg_id", "other", r(geo.least_endpoint_distance2("a", "b")).alias("d2"))


@query
def near_intersection(spark, sf_dir):
    net = network(spark)
    near = roads.grid_join(points(spark, sf_dir).select(*KEY, "x", "y"), net, 12.0).select(*KEY, "x", "y", "seg_id")
    return lc.near_node(near, net, roads.adjacency(net)).select(*KEY, "seg_id", "near_node")


def _lanes(spark, sf_dir, speed_detection: bool) -> DataFrame:
    p = obs.raw_speed(points(spark, sf_dir))
    return lc.lane_candidates(p, network(spark), "road", speed_detection).select(*KEY, "cand", r("emit_cost", 4))


@query
def lane_candidates(spark, sf_dir):
    return _lanes(spark, sf_dir, False)


@query
def lane_candidates_sd(spark, sf_dir):
    return _lanes(spark, sf_dir, True)
