"""Readers of the text formats. Each takes a path, or a DataFrame of lines (value), and gives typed rows; bad rows are dropped as described."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geo import gps_time_ms

# fixed values: the columns of an observation file, in order
OBSERVATION = (
    "year month day hour minute second week ws nsv sigma0 lat lon h vel_u vel_n vel_e pha_u pha_n pha_e sigma1 sigma2 lobs clk1 trop "
    "cbp2_0 cbp2_1 cbp2_2 cbp2_3 cbp2_4 isb_0 isb_1 isb_2 isb_3"
).split()
TAGS = ("GPS_matched", "GPS_inv", "GPS", "matched")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value and line, a number that keeps the order of the file."""
    return spark.read.text(path).withColumn("line", F.monotonically_increasing_id())


def _numbers(tokens: Column) -> Column:
    """The leading numbers: reading stops at the first token that is none."""
    parsed = F.transform(tokens, lambda t: t.try_cast("double"))
    bad = F.array_position(F.transform(parsed, lambda v: v.isNull()), F.lit(True))
    return F.slice(parsed, 1, F.when(bad > 0, bad - 1).otherwise(F.size(parsed)).cast("int"))


def observations(text: DataFrame) -> DataFrame:
    """Observation rows: white-space separated numbers, at least 33; later ones go to extra. Headers, blank and short lines are dropped.
    ts_ms comes from week and second of week."""
    n = text.withColumn("_n", _numbers(F.split(F.trim("value"), "\\s+"))).where(F.size("_n") >= len(OBSERVATION))
    keep = [c for c in text.columns if c != "value"]
    whole = ("year", "month", "day", "hour", "minute", "week", "nsv", "lobs")
    cols = [F.get("_n", F.lit(i)).cast("int" if c in whole else "double").alias(c) for i, c in enumerate(OBSERVATION)]
    extra = F.expr(f"slice(_n, {len(OBSERVATION) + 1}, greatest(size(_n) - {len(OBSERVATION)}, 0))").alias("extra")
    return n.select(*keep, *cols, extra).withColumn("ts_ms", gps_time_ms("week", "ws"))


def truth(text: DataFrame) -> DataFrame:
    """data_type, ts_ms, lat, lon, h, radius of lines like {'dataType':'GPS','timestamp':1,'x':lon,'y':lat,'z':h,'redius':r}; braces may be
    missing. A missing or malformed value is null; a line without a time stamp is dropped."""
    body = F.regexp_replace(F.trim("value"), r"^\{|\}$", "")
    get = lambda k: F.trim(F.regexp_extract(body, rf"(?:^|,)\s*'?{k}'?\s*:\s*'?([^',]*)", 1))
    num = lambda k, kind="double": F.nullif(get(k), F.lit("")).try_cast(kind)
    out = text.select(
        *[c for c in text.columns if c != "value"], F.nullif(get("dataType"), F.lit("")).alias("data_type"), num("timestamp", "bigint").alias("ts_ms"), num("y").alias("lat"), num("x").alias("lon"), num("z").alias("h"), num("redius").alias("radius")
    )
    return out.where("ts_ms is not null")


def track(text: DataFrame) -> DataFrame:
    """Matched tracks and state files: `tag ts lat lon h` or `ts lat lon h [x y v_e v_n v_u quality trusted reason]`; other lines are dropped."""
    t = text.withColumn("_t", F.split(F.trim("value"), "\\s+")).withColumn("_tag", F.when(F.element_at("_t", 1).isin(*TAGS), F.element_at("_t", 1)))
    t = t.withColumn("_v", F.when(F.col("_tag").isNotNull(), F.expr("slice(_t, 2, size(_t))")).otherwise(F.col("_t")))
    at = lambda i, kind="double": F.get("_v", F.lit(i)).try_cast(kind)
    bare = lambda i, kind="double": F.when(F.col("_tag").isNull(), at(i, kind))
    names = ("x", "y", "v_e", "v_n", "v_u")
    out = t.select(
        *[c for c in text.columns if c != "value"], F.col("_tag").alias("tag"), at(0, "bigint").alias("ts_ms"), at(1).alias("lat"), at(2).alias("lon"), at(3).alias("h"),
        *(bare(4 + i).alias(c) for i, c in enumerate(names)), F.coalesce(bare(9), F.lit(1.0)).alias("quality_score"), F.coalesce(bare(10, "int") != 0, F.lit(True)).alias("trusted"), F.coalesce(bare(11, "int"), F.lit(0)).alias("trust_reason"),
    )
    return out.where("ts_ms is not null and lat is not null and lon is not null and h is not null")


def road_matched(text: DataFrame, default_type: str = "GPS_matched", default_radius: float = 0.5) -> DataFrame:
    """data_type, ts_ms, lat, lon, h, radius: tagged lines carry a radius, bare ones get the default."""
    t = text.withColumn("_t", F.split(F.trim("value"), "\\s+")).withColumn("_o", F.when(F.element_at("_t", 1).try_cast("double").isNull(), 1).otherwise(0))
    at = lambda i, kind="double": F.get("_t", F.col("_o") + i).try_cast(kind)
    radius = F.coalesce(at(4), F.when(F.col("_o") == 0, F.lit(default_radius)))
    out = t.select(*[c for c in text.columns if c != "value"], F.when(F.col("_o") == 1, F.element_at("_t", 1)).otherwise(F.lit(default_type)).alias("data_type"), at(0, "bigint").alias("ts_ms"), at(1).alias("lat"), at(2).alias("lon"), at(3).alias("h"), radius.alias("radius"))
    return out.where("ts_ms is not null and lat is not null and lon is not null and h is not null and radius is not null")


def kml_roads(whole: DataFrame, three_part_only: bool = False, least_points: int = 2) -> DataFrame:
    """road_id, lane_id, lane_offset, name, points from DataFrame(file, value) of whole KML texts: one polyline for each <coordinates> element
    with at least least_points good tuples lon,lat[,h] (1: a lone vertex makes no segment, but counts in a network's centroid); h is 0 where missing, unless only three-part tuples count."""
    raw = whole.select("file", F.posexplode(F.regexp_extract_all("value", F.lit(r"<coordinates>([^<]+)</coordinates>"), F.lit(1))).alias("line", "text"))
    tuples = F.filter(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " "), lambda t: F.length(t) > 0)
    num = lambda t, i: F.get(F.split(t, ","), F.lit(i)).try_cast("double")
    points = F.transform(tuples, lambda t: F.struct(num(t, 1).alias("lat"), num(t, 0).alias("lon"), (num(t, 2) if three_part_only else F.coalesce(num(t, 2), F.lit(0.0))).alias("h")))
    good = raw.select("file", "line", F.filter(points, lambda p: p["lat"].isNotNull() & p["lon"].isNotNull() & p["h"].isNotNull()).alias("points")).where(F.size("points") >= least_points)
    from pyspark.sql import Window

    number = F.row_number().over(Window.partitionBy("file").orderBy("line")) - 1
    return good.select("file", number.alias("road_id"), F.lit(0).alias("lane_id"), F.lit(0.0).alias("lane_offset"), F.concat(F.lit("road_"), number.cast("string")).alias("name"), "points")


def read_kml(spark: SparkSession, path: str, three_part_only: bool = False, least_points: int = 2) -> DataFrame:
    return kml_roads(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value"), three_part_only, least_points)


def first_that_exists(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The track of the first path that can be read: the vehicle-state file, then the matched one."""
    from pyspark.errors import AnalysisException

    for path in paths[:-1]:
        try:
            return track(lines(spark, path))
        except AnalysisException:
            continue
    return track(lines(spark, paths[-1]))
