"""Streams give what the batch operators give, whatever the micro-batches."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from waymill.functions.constants import Ekf
from waymill.operators import ekf, speed_detection
from waymill.streaming import detect

POINT = "traj_id long, seq long, ts_ms long, x double, y double, v_e double, v_n double"


def rows():
    rng = np.random.default_rng(2)
    return [(t, i, 1000 * i, float(10 * i + rng.normal(0, 6)), float(rng.normal(0, 2)), 10.0, 0.0) for t in (1, 2) for i in range(40)]


def stream(spark, tmp_path, df, f):
    for k in range(4):
        df.where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = f(source).writeStream.format("memory").queryName("streamed").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination(240)
    return spark.table("streamed").orderBy("traj_id", "seq").toPandas()


def test_prediction(spark, tmp_path):
    df = spark.createDataFrame(rows(), POINT)
    got = stream(spark, tmp_path, df, detect.prediction)
    want = speed_detection.prediction(df).orderBy("traj_id", "seq").toPandas()
    assert got.trusted.tolist() == want.trusted.tolist() and got.quality_score.tolist() == pytest.approx(want.quality_score.tolist())


def test_fusion(spark, tmp_path):
    df = spark.createDataFrame(rows(), POINT).select("*", F.col("v_e").alias("vel_e"), F.col("v_n").alias("vel_n"), F.lit(1.0).alias("gnss_scale"))
    got = stream(spark, tmp_path, df, detect.fusion)
    pdf = df.toPandas().assign(o_x=np.nan, o_y=np.nan, road_scale=1.0)
    for t in (1, 2):
        want = ekf.fold(pdf[pdf.traj_id == t], Ekf())
        assert got[got.traj_id == t].x.tolist() == pytest.approx(want.x.tolist())
