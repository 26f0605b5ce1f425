"""As-of joins in time: the nearest row within a tolerance, and interpolation between neighbours.

Spark has no public as-of join, and an inequality join would pair every row with every other. Both sides are put under one window
instead: one shuffle by trajectory and one sort by time, the neighbours being the last and the first non-null right row. Duplicate
times on the right stand in the order they come in (seq), as in a list that a cursor runs through: of rows with one time the last is the one
at or before, the first the one after.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, quality


def neighbours(left: DataFrame, right: DataFrame, values: tuple[str, ...], last_of_equal: bool) -> DataFrame:
    """left with pred and succ: structs (ts, values) of right's rows at or before and after each of its times. Of rows with an equal time the
    last one is pred; succ is the first one, or the last if last_of_equal. Without seq, their values settle their order."""
    order = [c for c in ("seq",) if c in right.columns]
    item = F.struct(*order, F.col("ts_ms").alias("ts"), *values)
    one = right.groupBy("traj_id", "ts_ms").agg(F.max(item).alias("_last"), F.min(item).alias("_first"))
    names = left.columns
    marked = one.select(F.col("traj_id").alias("_traj"), F.col("ts_ms").alias("_ts"), F.lit(0).alias("_side"), F.struct("_last", F.col("_last" if last_of_equal else "_first").alias("_first")).alias("_item"), F.lit(None).cast(left.select(F.struct(*names).alias("r")).schema["r"].dataType).alias("_row"))
    own = left.select(F.col("traj_id").alias("_traj"), F.col("ts_ms").alias("_ts"), F.lit(1).alias("_side"), F.lit(None).cast(marked.schema["_item"].dataType).alias("_item"), F.struct(*names).alias("_row"))
    by = Window.partitionBy("_traj").orderBy("_ts", "_side")
    pred = F.last("_item", ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    # a right row of the very time is pred, so succ is strictly after it
    succ = F.last("_item", ignorenulls=True).over(Window.partitionBy("_traj").orderBy(F.col("_ts").desc(), F.col("_side").desc()).rowsBetween(Window.unboundedPreceding, 0))
    return marked.union(own).withColumns({"pred": pred["_last"], "succ": succ["_first"]}).where("_side = 1").select("_row.*", "pred", "succ")


def nearest(left: DataFrame, right: DataFrame, values: tuple[str, ...], tolerance_ms: int, tie: str) -> DataFrame:
    """left with m_ts and the values of right's nearest row, null beyond tolerance_ms (the tolerance itself is in reach). On a tie in time
    the `earlier` or the `later` row; of rows with one time, that of neighbours()."""
    n = neighbours(left, right, values, tie == "later")
    dp, ds = F.col("ts_ms") - F.col("pred.ts"), F.col("succ.ts") - F.col("ts_ms")
    take_succ = F.col("succ").isNotNull() & (F.col("pred").isNull() | ((ds <= dp) if tie == "later" else (ds < dp)))
    best = F.when(take_succ, F.col("succ")).otherwise(F.col("pred"))
    out = n.withColumn("_m", F.when(F.abs(best["ts"] - F.col("ts_ms")) <= tolerance_ms, best)).drop("pred", "succ")
    return out.select(*left.columns, F.col("_m.ts").alias("m_ts"), *(F.col(f"_m.{v}").alias(v) for v in values))


def matched(left: DataFrame, right: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """left with o_x, o_y, o_quality, o_trusted (and n_quality, that of the nearest row) from right(x, y, quality_score, trusted): between the
    neighbours in a straight line where both stand around the time and have a finite place, else the nearest; null if the nearest is beyond the
    tolerance or has no place itself. A missing quality counts as 1, before anything is interpolated."""
    values = ("m_x", "m_y", "m_quality", "m_trusted", "m_h")
    own = right.select("traj_id", *(c for c in ("seq",) if c in right.columns), "ts_ms", F.col("x").alias("m_x"), F.col("y").alias("m_y"), F.col("quality_score").alias("m_quality"), F.col("trusted").alias("m_trusted"), F.col("h").alias("m_h"))
    n = neighbours(left, own, values, False)
    t = F.col("ts_ms")
    dp, ds = t - F.col("pred.ts"), F.col("succ.ts") - t
    best = F.when(F.col("succ").isNotNull() & (F.col("pred").isNull() | (ds < dp)), F.col("succ")).otherwise(F.col("pred"))
    n = n.withColumn("_b", F.when(F.abs(best["ts"] - t) <= tolerance_ms, best))
    placed = lambda c: geo.is_finite(c["m_x"]) & geo.is_finite(c["m_y"])
    both = F.coalesce(F.col("succ.ts") > F.col("pred.ts"), F.lit(False)) & placed(F.col("pred")) & placed(F.col("succ"))
    a = (t - F.col("pred.ts")) / (F.col("succ.ts") - F.col("pred.ts"))
    between = lambda x, y: x + (y - x) * a
    mid = lambda c: between(F.col(f"pred.{c}"), F.col(f"succ.{c}"))
    found = F.col("_b").isNotNull() & (both | placed(F.col("_b")))
    pick = lambda inner, one: F.when(found, F.when(both, inner).otherwise(one))
    own_quality = lambda c: quality.safe_quality(F.col(f"{c}.m_quality"))
    return n.select(
        *left.columns,
        F.col("_b.ts").alias("m_ts"),
        pick(mid("m_x"), F.col("_b.m_x")).alias("o_x"),
        pick(mid("m_y"), F.col("_b.m_y")).alias("o_y"),
        pick(between(own_quality("pred"), own_quality("succ")), own_quality("_b")).alias("o_quality"),
        pick(F.col("pred.m_trusted") & F.col("succ.m_trusted"), F.col("_b.m_trusted")).alias("o_trusted"),
        F.col("_b.m_quality").alias("n_quality"),
        F.col("_b.m_h").alias("n_h"),
    )
