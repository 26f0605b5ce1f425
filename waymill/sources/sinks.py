"""Writers of the text formats, as columns of finished lines; write_lines puts them into files. Parquet is the native sink."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATE_HEADER = "timestamp_ms lat lon h x y vE vN vU quality trusted reason"
HMM_HEADER = "timestamp(ms, UTC)\tlatitude(deg)\tlongitude(deg)\theight(m)"
HMM_DEBUG_HEADER = "timestamp(ms)\tlat\tlon\tseg_id\tobs_dist(m)\temit_cost\temit_sigma\tinput_trusted\tinput_quality\tweak_obs"


def fixed(c: str | Column, digits: int = 10) -> Column:
    """A number with that many decimals; missing as nan."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.format_string(f"%.{digits}f", c.cast("double")), F.lit("nan")) if digits else c.cast("string")


def _number(c: str) -> Column:
    return F.when(F.col(c).isNull(), F.lit("nan")).otherwise(fixed(c))


def state_lines(points: DataFrame) -> DataFrame:
    """12 columns by blanks, ten decimals, trust as 0 or 1."""
    cols = [_number(c) for c in ("lat", "lon", "h", "x", "y", "v_e", "v_n", "v_u", "quality_score")]
    return points.select("traj_id", "seq", F.concat_ws(" ", F.col("ts_ms").cast("string"), *cols, F.col("trusted").cast("int").cast("string"), F.col("trust_reason").cast("string")).alias("line"))


def matched_lines(points: DataFrame) -> DataFrame:
    """GPS_matched ts lat lon h 0.5: lat, lon where matched, else the raw place."""
    return points.select("traj_id", "seq", F.concat_ws(" ", F.lit("GPS_matched"), F.col("ts_ms").cast("string"), _number("lat"), _number("lon"), _number("h"), F.lit("0.5")).alias("line"))


def hmm_lines(points: DataFrame) -> DataFrame:
    """ts, lat, lon, h by tabs, eight decimals."""
    return points.select("traj_id", "seq", F.concat_ws("\t", F.col("ts_ms").cast("string"), *(fixed(c, 8) for c in ("lat", "lon", "h"))).alias("line"))


def hmm_debug_lines(points: DataFrame) -> DataFrame:
    """What the hidden-Markov matcher chose and why: the columns of HMM_DEBUG_HEADER by tabs, reals with eight decimals. Unmatched rows have none."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    cols = [F.col("ts_ms").cast("string"), fixed("lat", 8), fixed("lon", 8), F.col("seg_id").cast("string"), fixed("obs_dist", 8), fixed("emit_cost", 8), fixed("emit_sigma", 8), flag("trusted"), fixed("quality_score", 8), flag("weak")]
    return points.where("seg_id is not null").select("traj_id", "seq", F.concat_ws("\t", *cols).alias("line"))


def track_kml(points: DataFrame, title: str = "Matched trajectory") -> DataFrame:
    """traj_id and one KML document of each trajectory's places in order, as a green line. A document is one trajectory, as in a fold."""
    item = F.struct("seq", F.concat_ws(",", _number("lon"), _number("lat"), F.coalesce(fixed("h"), F.lit("0"))).alias("at"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["at"]), "\n")
    head = (
        '<?xml version="1.0" encoding="UTF-8"?>\n<kml xmlns="http://www.opengis.net/kml/2.2">\n<Document>\n'
        f'<name>{title}</name>\n<Style id="line"><LineStyle><color>ff00ff00</color><width>4</width></LineStyle></Style>\n'
        '<Placemark>\n<styleUrl>#line</styleUrl>\n<LineString><tessellate>1</tessellate><coordinates>\n'
    )
    tail = "\n</coordinates></LineString>\n</Placemark>\n</Document>\n</kml>"
    return points.where("lat is not null and lon is not null").groupBy("traj_id").agg(F.concat(F.lit(head), body, F.lit(tail)).alias("line"))


def evaluation_lines(rows: DataFrame) -> DataFrame:
    """index, time, error before and after, truth and detection flags, trust, quality, by tabs."""
    flag = lambda c: F.col(c).cast("int").cast("string")
    return rows.select("traj_id", "seq", F.concat_ws("\t", F.col("seq").cast("string"), F.col("ts_ms").cast("string"), fixed("error_m", 8), fixed("error_m", 8), flag("truth_abnormal"), flag("sd_abnormal"), flag("trusted"), fixed("quality_score", 8)).alias("line"))


def kml(roads: DataFrame) -> DataFrame:
    """road_id, and one Placemark of each polyline of two points or more."""
    tuples = F.transform("points", lambda p: F.concat_ws(",", fixed(p["lon"]), fixed(p["lat"]), fixed(p["h"])))
    return roads.where(F.size("points") > 1).select("road_id", F.concat(F.lit("<Placemark><name>"), "name", F.lit("</name><LineString><coordinates>"), F.array_join(tuples, " "), F.lit("</coordinates></LineString></Placemark>")).alias("line"))


def lane_lines(points: DataFrame) -> DataFrame:
    """road_id lane_id point_id lat lon h offset_m by blanks."""
    return points.select("road_id", "point_id", F.concat_ws(" ", *(F.col(c).cast("string") for c in ("road_id", "lane_id", "point_id")), *(fixed(c) for c in ("lat", "lon", "h", "offset_m"))).alias("line"))


def write_lines(lines: DataFrame, path: str, by: tuple[str, ...] = ("traj_id", "seq")) -> None:
    """The lines in order, in part files that are read in order."""
    lines.orderBy(*by).select("line").write.mode("overwrite").text(path)


def write_tracks(lines: DataFrame, path: str, by: tuple[str, ...] = ("traj_id", "seq")) -> None:
    """The lines in order, in a folder traj_id=... for each trajectory, so that reading gives the trajectory back."""
    lines.repartitionByRange(*by).sortWithinPartitions(*by).select("traj_id", "line").write.mode("overwrite").partitionBy("traj_id").text(path)


def write_kml(roads: DataFrame, path: str) -> None:
    """One document: a network's file is read whole anyway."""
    body = roads.transform(kml).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("road_id", "line"))), lambda x: x["line"]), "\n").alias("b"))
    head, tail = '<?xml version="1.0" encoding="UTF-8"?>\n<kml><Document>\n', "\n</Document></kml>"
    body.select(F.concat(F.lit(head), F.coalesce("b", F.lit("")), F.lit(tail)).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def sibling(path: str, suffix: str) -> str:
    """The same place and stem with a suffix: a debug file beside its output."""
    p = PurePosixPath(path)
    return str(p.with_name(f"{p.stem}{suffix}{p.suffix}"))


def ekf_output(source: str, sd_match: bool, sd_noise: bool) -> str:
    return f"ekf_{source}_{'sdmatch' if sd_match else 'normalmatch'}_{'sdnoise' if sd_noise else 'fixednoise'}_points.txt"
