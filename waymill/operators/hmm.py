"""Hidden-Markov map matching: candidates, emission and transition costs as relations, then a Viterbi fold per chain."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, quality
from ..functions.constants import Hmm
from .observations import chains, ordered
from .roads import checkpointed, edges, grid_join, merged_nodes, wanted_paths


def candidates(points: DataFrame, segs: DataFrame, o: Hmm = Hmm()) -> DataFrame:
    """The nearest top_k segments within the radius of each point(traj_id, seq, x, y), by distance and then id; the very nearest alone where
    none is in reach, found by ever wider radii for just those points."""
    keys = ["traj_id", "seq"]
    own = points.select(*keys, "x", "y")
    cols = [*keys, "seg_id", F.col("px").alias("cx"), F.col("py").alias("cy"), "s", "obs_dist"]
    found = grid_join(own, segs, o.radius_m).select(*cols)
    rest, radius = checkpointed(own.join(found.select(*keys).distinct(), keys, "left_anti")), o.radius_m
    extra = None
    for _ in range(12):
        if not rest.limit(1).count():
            break
        radius *= 4
        hit = grid_join(rest, segs, radius).select(*cols)
        one = hit.groupBy(*keys).agg(F.min(F.struct("obs_dist", "seg_id", "cx", "cy", "s")).alias("m")).select(*keys, "m.seg_id", "m.cx", "m.cy", "m.s", "m.obs_dist")
        extra = one if extra is None else extra.unionByName(one)
        rest = checkpointed(rest.join(hit.select(*keys).distinct(), keys, "left_anti"))
    best = Window.partitionBy(*keys).orderBy("obs_dist", "seg_id")
    top = found.withColumn("cand", F.row_number().over(best) - 1).where(F.col("cand") < o.top_k)
    return top if extra is None else top.unionByName(extra.withColumn("cand", F.lit(0)))


def emissions(points: DataFrame, cands: DataFrame, speed_detection: bool = False, o: Hmm = Hmm()) -> DataFrame:
    """cands with weak, emit_sigma, emit_cost."""
    q = quality.hmm_quality(F.col("quality_score"), speed_detection, o)
    own = points.select("traj_id", "seq", q.alias("_q"), quality.weak(F.col("trusted"), q, speed_detection, o).alias("weak"))
    out = cands.join(own, ["traj_id", "seq"]).withColumn("emit_sigma", quality.emission_sigma(F.col("_q"), F.col("weak"), o))
    return out.withColumn("emit_cost", quality.emission_cost(F.col("obs_dist"), F.col("emit_sigma"))).drop("_q")


def observation_steps(points: DataFrame, o: Hmm = Hmm()) -> DataFrame:
    """traj_id, seq, chain_id, step: the distance to the observation before, held to 0..max_step_m."""
    step = geo.clamp(geo.distance(F.col("x"), F.col("y"), F.lag("x").over(ordered()), F.lag("y").over(ordered())), 0.0, o.max_step_m)
    return chains(points.withColumn("step", step), o.gap_s).select("traj_id", "seq", "chain_id", "step", F.lag("seq").over(ordered()).alias("before"), F.lag("chain_id").over(ordered()).alias("chain_before"))


def candidate_pairs(cands: DataFrame, stepped: DataFrame, segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Every candidate of a point with every one of the point before in its chain (top_k squared at most), with both segments' nodes."""
    with_nodes = cands.join(segs.select("seg_id", "len").join(nodes, "seg_id"), "seg_id")
    cur = with_nodes.join(stepped.where("chain_id = chain_before").select("traj_id", "seq", "chain_id", "step", "before"), ["traj_id", "seq"])
    prev = with_nodes.select("traj_id", F.col("seq").alias("before"), *(F.col(c).alias(f"p_{c}") for c in ("cand", "seg_id", "s", "len", "u", "v", "weak") if c in with_nodes.columns))
    return cur.join(prev, ["traj_id", "before"])


ENDS = tuple((f"{p}{c}", p, c) for p in "uv" for c in "uv")


def segment_pairs(pairs: DataFrame) -> DataFrame:
    """The different pairs of segments that candidate_pairs go between, with the nodes of both: far fewer than pairs of candidates."""
    return pairs.where("seg_id <> p_seg_id").select("p_seg_id", "seg_id", "p_u", "p_v", "u", "v").distinct()


def wanted_ends(between: DataFrame) -> DataFrame:
    """src, dst of all ways between the ends of segment_pairs."""
    ways = F.array(*(F.struct(F.col(f"p_{p}").alias("src"), F.col(c).alias("dst")) for _, p, c in ENDS))
    return between.select(F.explode(ways).alias("w")).select("w.*").distinct()


def route_distances(pairs: DataFrame, distances: DataFrame, between: DataFrame | None = None) -> DataFrame:
    """pairs with route: along the segment if it is one, else the least way over an end of each; null if there is none. Node distances are put
    together for pairs of segments first, so that candidates meet one row."""
    between = between or segment_pairs(pairs)
    ways = F.array(*(F.struct(F.lit(name).alias("way"), F.col(f"p_{p}").alias("src"), F.col(c).alias("dst")) for name, p, c in ENDS))
    long = between.select("p_seg_id", "seg_id", F.explode(ways).alias("w")).select("p_seg_id", "seg_id", "w.*").join(distances, ["src", "dst"])
    known = long.groupBy("p_seg_id", "seg_id").agg(*(F.min(F.when(F.col("way") == name, F.col("d"))).alias(f"_{name}") for name, _, _ in ENDS))
    leave = {"u": F.col("p_s"), "v": F.col("p_len") - F.col("p_s")}
    met = {"u": lambda left: left + F.col("s"), "v": lambda left: left + F.col("len") - F.col("s")}  # from left to right as in SQL: ways of one length differ by the last bit
    over = F.least(*(met[c](leave[p]) + F.col(f"_{name}") for name, p, c in ENDS))
    out = pairs.join(known, ["p_seg_id", "seg_id"], "left")
    return out.withColumn("route", F.when(F.col("seg_id") == F.col("p_seg_id"), F.abs(F.col("s") - F.col("p_s"))).otherwise(over)).drop(*(f"_{name}" for name, _, _ in ENDS))


def transition_costs(routes: DataFrame, o: Hmm = Hmm()) -> DataFrame:
    either = F.col("weak") | F.col("p_weak")
    step = F.when(either, F.least("step", F.lit(o.weak_step_m))).otherwise(F.col("step"))
    cost = F.abs(F.col("route") - step) / F.when(either, o.weak_beta_m).otherwise(o.beta_m)
    return routes.withColumn("trans_cost", F.coalesce(cost, F.lit(o.unreachable)))


def viterbi(emitted: DataFrame, stepped: DataFrame, transitions: DataFrame) -> DataFrame:
    """traj_id, seq, cand, cost: the path of least cost through each chain; the lowest candidate wins ties. One group is one chain."""
    keys = ["traj_id", "chain_id", "seq"]
    e = emitted.join(stepped.select(*keys), ["traj_id", "seq"]).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cand", "emit_cost"))).alias("e"))
    e = e.select(*keys, F.col("e.emit_cost").alias("emit"))
    t = transitions.groupBy(*keys).agg(F.collect_list(F.struct("p_cand", "cand", "trans_cost")).alias("t"))
    t = t.select(*keys, F.col("t.p_cand").alias("of"), F.col("t.cand").alias("to"), F.col("t.trans_cost").alias("trans"))  # flat arrays: no objects in Python
    rows = e.join(t, keys, "left")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("seq")
        back, cost, costs = [], None, []
        for e, of, to, trans in zip(pdf["emit"], pdf["of"], pdf["to"], pdf["trans"], strict=True):
            if cost is None:
                cost = e
                back.append(np.zeros(len(e), int))
            else:
                m = np.full((len(cost), len(e)), np.inf)
                if trans is not None:
                    m[of, to] = trans
                m = cost[:, None] + m
                back.append(m.argmin(0))
                cost = m.min(0) + e
            costs.append(float(cost.min()))
        at = int(cost.argmin())
        path = [0] * len(back)
        for i in range(len(back) - 1, -1, -1):
            path[i] = at
            at = int(back[i][at])
        return pd.DataFrame({"traj_id": pdf["traj_id"], "seq": pdf["seq"], "chain_id": pdf["chain_id"], "cand": path, "cost": costs})

    return rows.groupBy("traj_id", "chain_id").applyInPandas(run, "traj_id long, seq long, chain_id long, cand int, cost double")


def match(points: DataFrame, segs: DataFrame, speed_detection: bool = False, o: Hmm = Hmm(), route_most: float = math.inf) -> DataFrame:
    """points(traj_id, seq, ts_ms, x, y, quality_score, trusted) with seg_id, mx, my, obs_dist, emit_cost and, without speed detection, the
    matcher's own quality, trust and reason. Chains are matched each on its own: one that fails doesn't take the others with it."""
    cands = checkpointed(candidates(points, segs, o))
    nodes = checkpointed(merged_nodes(segs, o.merge_m))
    stepped = observation_steps(points, o)
    emitted = emissions(points, cands, speed_detection, o)
    pairs = candidate_pairs(emitted, stepped, segs, nodes)
    between = checkpointed(segment_pairs(pairs))
    distances = wanted_paths(edges(segs, nodes), wanted_ends(between), route_most)
    costs = transition_costs(route_distances(pairs, distances, between), o)
    chosen = viterbi(emitted, stepped, costs)
    out = points.join(chosen, ["traj_id", "seq"], "left").join(emitted.select("traj_id", "seq", "cand", "seg_id", F.col("cx").alias("mx"), F.col("cy").alias("my"), "obs_dist", "emit_cost", "emit_sigma"), ["traj_id", "seq", "cand"], "left")
    if speed_detection:
        return out
    near = F.col("obs_dist") < o.radius_m
    return out.withColumns({"quality_score": geo.clamp(F.exp(-F.col("emit_cost")), 0.05, 1.0), "trusted": F.coalesce(near, F.lit(False)), "trust_reason": F.when(near, 0).otherwise(1)})
