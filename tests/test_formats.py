"""Text formats: what is read, what is dropped, and round trips."""

import pytest

from waymill.sources import sinks, text


def lines(spark, *rows):
    return spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line long, value string")


def test_observation_lines(spark):
    good = " ".join(str(i) for i in range(33))
    rows = text.observations(lines(spark, "header of names", "", good, good + " 1.5 2.5", " ".join(good.split()[:32]), good.replace(" 20 ", " twenty "))).collect()
    assert [r.line for r in rows] == [2, 3]
    assert rows[0].extra == [] and rows[1].extra == [1.5, 2.5]
    r = rows[0]
    assert (r.week, r.ws, r.lat, r.lon, r.vel_u, r.vel_n, r.vel_e, r.pha_u, r.pha_e) == (6, 7.0, 10.0, 11.0, 13.0, 14.0, 15.0, 16.0, 18.0)
    assert r.ts_ms == round((6 * 604800 + 7 + 315964800) * 1000)


def test_truth_lines(spark):
    rows = text.truth(lines(spark, "{'dataType':'GPS','timestamp':1678330000000,'x':120.0001,'y':30.0002,'z':12.5,'redius':0.5}", "'timestamp':5, 'y': 1.5", "", "{'timestamp':'x'}")).collect()
    assert [(r.data_type, r.ts_ms, r.lat, r.lon, r.h, r.radius) for r in rows] == [("GPS", 1678330000000, 30.0002, 120.0001, 12.5, 0.5), (None, 5, 1.5, None, None, None)]


def test_track_lines(spark):
    rows = text.track(lines(spark, "GPS_matched 5 30 120 7 0.5", "6 30 120 7", "7 30 120 7 1 2 3 4 5 0.5 0 20", "timestamp_ms lat lon h", "8 30 x 7", "timestamp(ms, UTC)\tlatitude(deg)\tlongitude(deg)\theight(m)", "9\t30\t120\t7")).collect()
    assert [(r.tag, r.ts_ms, r.x, r.quality_score, r.trusted, r.trust_reason) for r in rows] == [("GPS_matched", 5, None, 1.0, True, 0), (None, 6, None, 1.0, True, 0), (None, 7, 1.0, 0.5, False, 20), (None, 9, None, 1.0, True, 0)]


def test_kml(spark):
    doc = "<kml><coordinates>1,2 3,4,5\n bad,1 6,7,8</coordinates><coordinates>1,2,3</coordinates><coordinates> 0,0,0 1,1,1 </coordinates></kml>"
    whole = spark.createDataFrame([("f", doc)], "file string, value string")
    rows = text.kml_roads(whole).orderBy("road_id").collect()
    assert [[(p.lon, p.lat, p.h) for p in r.points] for r in rows] == [[(1, 2, 0), (3, 4, 5), (6, 7, 8)], [(0, 0, 0), (1, 1, 1)]]
    strict = text.kml_roads(whole, three_part_only=True).orderBy("road_id").collect()
    assert [len(r.points) for r in strict] == [2, 2] and [r.road_id for r in strict] == [0, 1]


def test_written_files_read_back(spark, tmp_path):
    roads = text.kml_roads(spark.createDataFrame([("f", "<coordinates>1,2,3 4,5,6</coordinates>")], "file string, value string"))
    sinks.write_kml(roads, f"{tmp_path}/roads.kml")
    back = text.read_kml(spark, f"{tmp_path}/roads.kml")
    assert [r.points for r in back.collect()] == [r.points for r in roads.collect()]
    state = text.track(lines(spark, *(f"{i} 30.5 120.25 7 1 2 3 4 5 0.5 1 0" for i in range(50)))).withColumnsRenamed({"line": "seq"}).selectExpr("1 traj_id", "*")
    sinks.write_lines(sinks.state_lines(state), f"{tmp_path}/state.txt")
    again = text.track(text.lines(spark, f"{tmp_path}/state.txt")).orderBy("line").collect()
    assert [(r.ts_ms, r.lat, r.v_u, r.trusted) for r in again] == [(i, 30.5, 5.0, True) for i in range(50)]


def test_missing_numbers_are_written_as_nan_and_read_as_missing(spark):
    point = spark.createDataFrame([(1, 1, 5, 30.0, 120.0, 7.0, None, 2.0, 0.0, 0.0, 0.0, 1.0, True, 0)], "traj_id long, seq long, ts_ms long, lat double, lon double, h double, x double, y double, v_e double, v_n double, v_u double, quality_score double, trusted boolean, trust_reason int")
    line = sinks.state_lines(point).first().line
    assert line == "5 30.0000000000 120.0000000000 7.0000000000 nan 2.0000000000 0.0000000000 0.0000000000 0.0000000000 1.0000000000 1 0"


@pytest.mark.parametrize(("source", "match", "noise", "name"), [("mm", True, False, "ekf_mm_sdmatch_fixednoise_points.txt"), ("hmm", False, True, "ekf_hmm_normalmatch_sdnoise_points.txt")])
def test_names(source, match, noise, name):
    assert sinks.ekf_output(source, match, noise) == name
    assert sinks.sibling("a/b.txt", "_debug") == "a/b_debug.txt"
