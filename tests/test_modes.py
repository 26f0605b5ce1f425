"""The four modes over small generated files, from reading to writing."""

import numpy as np
import pytest

from waymill.plans import modes
from waymill.sources import text


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("modes")
    rng = np.random.default_rng(1)
    start = 1678329800.0
    for name in ("a", "b"):
        rows, truth = ["header"], []
        for i in range(60):
            s = start + i
            week, ws = divmod(s - 315964800, 604800)
            x, y = 10.0 * i + rng.normal(0, 2) + (40 if i == 30 else 0), rng.normal(0, 2) + (300 if name == "b" else 0)
            lat, lon = 30 + y * 9e-6, 120 + x * 1.04e-5
            v = ["2023", "3", "9", "1", "1", "1.0", str(int(week)), f"{ws:.3f}", "9", "1", f"{lat:.9f}", f"{lon:.9f}", "12.0", "0", "0", "10", "0", "0", "10", *["0"] * 14]
            rows.append(" ".join(v))
            truth.append(f"{{'dataType':'GPS','timestamp':{int(s * 1000)},'x':{120 + 10.0 * i * 1.04e-5:.9f},'y':{30.0 + (0.0027 if name == 'b' else 0.0)},'z':12,'redius':0.5}}")
        (at / f"{name}.obs").write_text("\n".join(rows))
        (at / f"{name}.truth").write_text("\n".join(truth))
    lines = [" ".join(f"{120 + 50 * k * 1.04e-5:.9f},{30 + north * 9e-6:.9f},5" for k in range(-1, 14)) for north in (0, 300)]
    (at / "roads.kml").write_text("<kml>" + "".join(f"<coordinates>{x}</coordinates>" for x in [*lines, "121.0,31.0,5"]) + "</kml>")
    return at


def test_speed_detection(spark, folder):
    own = modes.read_observations(spark, f"{folder}/*.obs")
    assert own.count() == 120 and own.select("traj_id").distinct().count() == 2
    metrics, rows = modes.evaluate_speed_detection(own, modes.read_truth(spark, f"{folder}/[ab].truth"))
    m = metrics.first()
    assert m.n == 120 and m.tp >= 2 and m.recall > 0.1 and rows.count() == 120


@pytest.mark.parametrize("mode", ["mm", "hmm"])
def test_match_then_fuse(spark, folder, mode, tmp_path):
    out = f"{tmp_path}/{mode}"
    modes.main([mode, "--observations", f"{folder}/*.obs", "--roads", f"{folder}/roads.kml", "--out", out, "--sd"])
    back = text.track(text.lines(spark, f"{out}/{mode}_sd_car_points.txt")).toPandas()
    assert len(back) == 120 and back.traj_id.nunique() == 2
    north = back.groupby("traj_id").lat.mean()  # two vehicles at the same times, 300 m apart
    assert sorted(round((v - 30) / 9e-6 / 300) for v in north) == [0, 1] and (np.abs(back.lat - back.traj_id.map(north)) < 3.0e-5).all()
    places = text.kml_roads(spark.read.text(f"{out}/{mode}_sd_matched_points.kml", wholetext=True).selectExpr("string(traj_id) file", "value")).collect()
    assert sorted(len(r.points) for r in places) == [60, 60]
    if mode == "hmm":
        debug = [r.value.split("\t") for r in spark.read.text(f"{out}/hmm_sd_matched_points_debug.txt").collect()]
        assert len(debug) == 120 and all(len(x) == 10 and x[7] in "01" and x[9] in "01" and float(x[6]) >= 8 for x in debug)
    modes.main(["ekf", "--observations", f"{folder}/*.obs", "--out", out, "--sd", "--sd-noise", "--source", mode])
    fused = text.track(text.lines(spark, f"{out}/ekf_{mode}_sdmatch_sdnoise_points.txt")).toPandas()
    assert len(fused) == 120 and fused.quality_score.between(0, 1).all()
    assert (np.abs(fused.lat - fused.traj_id.map(north)) < 6.0e-5).all()  # each by its own track


def test_truth_of_another_name(spark, folder):
    """One trajectory and one truth file belong together; of several, those that are named."""
    own = modes.read_observations(spark, f"{folder}/a.obs")
    for path, pairs in ((f"{folder}/a.truth", []), (f"{folder}/other.truth", []), (None, [f"a={folder}/other.truth"])):
        (folder / "other.truth").write_text((folder / "a.truth").read_text())
        metrics, _ = modes.evaluate_speed_detection(own, modes.truth_of(spark, own, path, pairs))
        assert metrics.first().n == 60
    both = modes.read_observations(spark, f"{folder}/[ab].obs")
    metrics, _ = modes.evaluate_speed_detection(both, modes.truth_of(spark, both, f"{folder}/[a]*.truth", [f"b={folder}/b.truth"]))
    assert metrics.first().n == 120
    with pytest.raises(ValueError, match="STEM"):
        modes.truth_of(spark, both, None, ["b"])


def test_a_lone_vertex_counts_in_the_centroid(spark, folder):
    from waymill.operators import roads

    two, one = (text.read_kml(spark, f"{folder}/roads.kml", True, n) for n in (2, 1))
    assert (two.count(), one.count()) == (2, 3)
    assert roads.vertex_frame(one)[0] > roads.vertex_frame(two)[0] + 0.01
    assert roads.segments(one, (30.0, 120.0)).count() == roads.segments(two, (30.0, 120.0)).count() == 28
