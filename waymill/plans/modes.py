"""The four ways to run the engine over files: evaluate speed detection, match by state machine, match by hidden Markov model, fuse.

Observation files are read by glob; the file's stem is the trajectory, so many trajectories run at once. Results are DataFrames; write_* put
them into text files of the usual formats under an output folder, where fusion finds the matched tracks of an earlier run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, quality
from ..functions.constants import EXCLUDE_WINDOWS, KEEP_WINDOW, Ekf
from ..operators import ekf, hmm, observations as obs, roads, speed_detection as sd, state_machine as sm
from ..sources import sinks, text

Windows = tuple[tuple[int, int], ...]


def stem() -> Column:
    """A trajectory's number: a hash of its file's name without folder and ending."""
    return F.xxhash64(F.regexp_extract(F.input_file_name(), r"([^/]+?)(?:\.[^./]*)?$", 1))


def read_observations(spark: SparkSession, path: str, keep: tuple[int, int] | None = KEEP_WINDOW, exclude: Windows = EXCLUDE_WINDOWS) -> DataFrame:
    """Observations with traj_id, seq, default trust and quality; filtered by time unless keep is None."""
    raw = text.observations(text.lines(spark, path).withColumn("traj_id", stem())).withColumnRenamed("line", "seq")
    own = raw.withColumns({"quality_score": F.lit(1.0), "trusted": F.lit(True), "trust_reason": F.lit(0)})
    own = own.withColumns({c: F.nullif(F.col(c), F.lit(float("nan"))) for c in ("lat", "lon", "h", "vel_u", "vel_n", "vel_e", "pha_u", "pha_n", "pha_e")})
    return obs.time_window_filter(own, keep, exclude) if keep else own


def read_truth(spark: SparkSession, path: str, of: str | None = None) -> DataFrame:
    """Truth rows of the trajectory with the same file stem, or of the one whose stem is `of`."""
    whose = F.xxhash64(F.lit(of)) if of else stem()
    return text.truth(text.lines(spark, path).withColumn("traj_id", whose)).withColumnRenamed("line", "seq")


def truth_of(spark: SparkSession, own: DataFrame, path: str | None, pairs: list[str]) -> DataFrame:
    """Truth by stem from path, and from STEM=PATH pairs. One truth file and one trajectory belong together whatever their names."""
    found = [read_truth(spark, path)] if path else []
    for pair in pairs:
        of, _, at = pair.partition("=")
        if not at:
            raise ValueError(f"not STEM=PATH: {pair}")
        found.append(read_truth(spark, at, of))
    if not found:
        raise ValueError("speed detection is evaluated against truth")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    ids = [[r.traj_id for r in df.select("traj_id").distinct().limit(2).collect()] for df in (own, out)]
    return out.withColumn("traj_id", F.lit(ids[0][0]).cast("long")) if not pairs and len(ids[0]) == len(ids[1]) == 1 else out


def read_track(spark: SparkSession, paths: list[str], own: DataFrame) -> DataFrame:
    """The matched tracks that write_tracks wrote. A file without a trajectory's name is that of the only one there is."""
    track = text.first_that_exists(spark, paths).drop("tag").withColumnRenamed("line", "seq")
    if "traj_id" in track.columns:
        return track.withColumn("traj_id", F.col("traj_id").cast("long"))
    ids = [r.traj_id for r in own.select("traj_id").distinct().limit(2).collect()]
    if len(ids) > 1:
        raise ValueError("a track without a trajectory's name, and several trajectories")
    return track.withColumn("traj_id", F.lit(ids[0] if ids else None).cast("long"))


def evaluate_speed_detection(observations: DataFrame, truth: DataFrame, mode: int = 2) -> tuple[DataFrame, DataFrame]:
    """Metrics and rows of observations and truth, both by traj_id. Mode 1 needs no matching, so no time window is applied before."""
    points = sd.detect(obs.car_points(observations), mode)
    return sd.evaluate(points, truth), sd.evaluation_rows(points, truth)


def lane_network(road_network: DataFrame) -> DataFrame:
    return roads.virtual_lanes(road_network)


def _framed(observations: DataFrame, road_network: DataFrame) -> tuple[DataFrame, DataFrame, tuple[float, float]]:
    """Points and segments in the frame of all vertices; only three-part tuples count there."""
    ref = roads.vertex_frame(road_network)
    return obs.with_frame(observations, ref), roads.segments(road_network, ref), ref


def _placed(matched: DataFrame, ref: tuple[float, float], digits: int) -> DataFrame:
    lat0, lon0 = F.lit(ref[0]), F.lit(ref[1])
    return matched.withColumns({"lat": F.round(geo.to_lat(F.col("my"), lat0), digits), "lon": F.round(geo.to_lon(F.col("mx"), lat0, lon0), digits)})


def match_by_state_machine(observations: DataFrame, road_network: DataFrame, speed_detection: bool = False) -> DataFrame:
    """Matched states on the raw network, with lane offsets as they go."""
    points, segs, ref = _framed(observations, road_network)
    found = _placed(sm.match(points, segs, speed_detection), ref, 10)
    rest = points.select("traj_id", "seq", "h", F.col("vel_e").alias("v_e"), F.col("vel_n").alias("v_n"), F.col("vel_u").alias("v_u"))
    return obs.with_frame(found.drop("mx", "my").join(rest, ["traj_id", "seq"]))


def match_by_hmm(observations: DataFrame, road_network: DataFrame, speed_detection: bool = False, lanes: bool = True) -> DataFrame:
    """Matched states on the network of virtual lanes."""
    network = lane_network(road_network) if lanes else road_network
    points, segs, ref = _framed(observations, network)
    if speed_detection:
        scored = sd.prediction(obs.car_points(observations)).select("traj_id", "seq", "trusted", "trust_reason", "quality_score")
        points = points.drop("trusted", "trust_reason", "quality_score").join(scored, ["traj_id", "seq"])
    points = points.withColumns({"raw_lat": F.col("lat"), "raw_lon": F.col("lon")})
    found = _placed(hmm.match(points, segs, speed_detection), ref, 8)
    weak = quality.weak(F.col("trusted"), quality.hmm_quality(F.col("quality_score"), speed_detection), speed_detection)
    found = found.withColumns({"weak": weak, "lat": F.coalesce("lat", F.col("raw_lat")), "lon": F.coalesce("lon", F.col("raw_lon"))})
    out = found.select("traj_id", "seq", "ts_ms", "seg_id", "obs_dist", "emit_cost", "emit_sigma", "weak", "lat", "lon", "h", F.col("vel_e").alias("v_e"), F.col("vel_n").alias("v_n"), F.col("vel_u").alias("v_u"), "trusted", "trust_reason", "quality_score")
    return obs.with_frame(out)


def fuse(observations: DataFrame, matched: DataFrame, source: str = "mm", sd_noise: bool = False, sd_match: bool = False) -> DataFrame:
    """Fused states; the track's noise is larger where it comes from a hidden Markov model with speed detection."""
    ref = observations.where(geo.is_finite("lat") & geo.is_finite("lon")).agg(F.avg("lat").alias("a"), F.avg("lon").alias("b")).first()
    frame = (ref.a or 0.0, ref.b or 0.0)
    points = obs.with_frame(observations, frame)
    if sd_noise:
        scored = sd.prediction(obs.car_points(observations)).select("traj_id", "seq", "trusted", "trust_reason", "quality_score")
        points = points.drop("trusted", "trust_reason", "quality_score").join(scored, ["traj_id", "seq"])
    o = Ekf(road_m=3.0) if source == "hmm" and sd_match else Ekf()
    return ekf.fuse(points, obs.with_frame(matched.drop("x", "y"), frame), frame, o)


def write_states(points: DataFrame, path: str) -> None:
    sinks.write_tracks(sinks.state_lines(points), path)


def main(args: list[str] | None = None) -> None:
    import argparse

    p = argparse.ArgumentParser(prog="waymill", description="Evaluate speed detection, match trajectories to roads, or fuse them.")
    p.add_argument("mode", choices=("sd", "mm", "hmm", "ekf"))
    p.add_argument("--observations", required=True)
    p.add_argument("--truth", help="files whose stems are those of observations, or one file for one trajectory")
    p.add_argument("--truth-of", action="append", default=[], metavar="STEM=PATH", help="truth of the observations with that file stem")
    p.add_argument("--roads")
    p.add_argument("--out", required=True)
    p.add_argument("--sd", action="store_true", help="speed detection inside the matcher (mm, hmm), or in the matched track that is read (ekf)")
    p.add_argument("--sd-noise", action="store_true", help="speed detection scales the noise of observations (ekf)")
    p.add_argument("--sd-mode", type=int, default=2, choices=(1, 2))
    p.add_argument("--source", default="mm", choices=("mm", "hmm"))
    p.add_argument("--no-window", action="store_true", help="no filter by time")
    a = p.parse_args(args)
    spark = SparkSession.builder.appName("waymill").getOrCreate()
    own = read_observations(spark, a.observations, None if a.no_window or a.mode == "sd" else KEEP_WINDOW)
    tag = "_sd" if a.sd else ""
    if a.mode == "sd":
        metrics, rows = evaluate_speed_detection(own, truth_of(spark, own, a.truth, a.truth_of), a.sd_mode)
        sinks.write_lines(sinks.evaluation_lines(rows), f"{a.out}/sd_debug.txt")
        metrics.show(truncate=False)
    elif a.mode in ("mm", "hmm"):
        network = text.read_kml(spark, a.roads, three_part_only=True)
        if a.mode == "hmm":
            lanes = lane_network(network)
            sinks.write_kml(lanes, f"{a.out}/lanes.kml")
            sinks.write_lines(sinks.lane_lines(roads.lane_points(lanes)), f"{a.out}/lanes.txt", ("road_id", "point_id"))
        found = roads.checkpointed((match_by_state_machine if a.mode == "mm" else match_by_hmm)(own, network, a.sd))
        matched = f"{a.out}/{a.mode}{tag}_matched_points.txt"
        sinks.write_tracks((sinks.matched_lines if a.mode == "mm" else sinks.hmm_lines)(found), matched)
        if a.mode == "hmm":
            sinks.write_tracks(sinks.hmm_debug_lines(found), sinks.sibling(matched, "_debug"))
        sinks.write_tracks(sinks.track_kml(found), f"{a.out}/{a.mode}{tag}_matched_points.kml", ("traj_id",))
        write_states(found, f"{a.out}/{a.mode}{tag}_car_points.txt")
    else:
        stored = [f"{a.out}/{a.source}{tag}_car_points.txt", f"{a.out}/{a.source}{tag}_matched_points.txt"]
        track = read_track(spark, stored, own)
        write_states(fuse(own, track, a.source, a.sd_noise, a.sd), f"{a.out}/{sinks.ekf_output(a.source, a.sd, a.sd_noise)}")
