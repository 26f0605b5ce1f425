"""Road networks: segments, virtual lanes, spatial joins, adjacency, clusters, graph nodes and edges, shortest paths.

Polylines are rows (road_id, lane_id, lane_offset, name, points array of struct(lat, lon, h)). Segment ids keep the order of the file,
road_id * 2**20 + number in the road, and need no global count.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.constants import LANE_OFFSETS, Hmm, StateMachine

SEGMENT_BITS = 20
MOST_SEGMENTS = 2_000_000  # of a network that is sent whole to every executor


def vertex_frame(roads: DataFrame) -> tuple[float, float]:
    """The centroid of all vertices, repeated ones each time; (0, 0) without any."""
    r = roads.select(F.explode("points").alias("p")).agg(F.avg("p.lat").alias("lat"), F.avg("p.lon").alias("lon")).first()
    return (r.lat or 0.0, r.lon or 0.0)


def segments(roads: DataFrame, ref: tuple[float, float]) -> DataFrame:
    """seg_id, road_id, lane_id, x1, y1, x2, y2, heading, len of each pair of neighbouring vertices, in the frame ref."""
    steps = F.transform(F.slice("points", 2, F.greatest(F.size("points") - 1, F.lit(0))), lambda p, i: F.struct(F.element_at("points", i + 1).alias("a"), p.alias("b")))
    s = roads.where(F.size("points") > 1).select("road_id", "lane_id", F.posexplode(steps).alias("i", "s"))
    lat0, lon0 = F.lit(ref[0]), F.lit(ref[1])
    xy = {f"{a}{n}": f for n, p in ((1, "a"), (2, "b")) for a, f in (("x", geo.to_x(F.col(f"s.{p}.lon"), lat0, lon0)), ("y", geo.to_y(F.col(f"s.{p}.lat"), lat0)))}
    s = s.withColumn("seg_id", F.shiftleft(F.col("road_id").cast("long"), SEGMENT_BITS) + F.col("i")).withColumns(xy)
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return s.select("seg_id", "road_id", "lane_id", "x1", "y1", "x2", "y2", F.atan2(dy, dx).alias("heading"), F.sqrt(dx * dx + dy * dy).alias("len"))


def offset_line(points: Column, offset: Column) -> Column:
    """A polyline moved to the left by offset, in the frame of its own centroid; along the tangent from the vertex before to the one after."""
    n = F.size(points)
    lat0 = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["lat"]) / n
    lon0 = F.aggregate(points, F.lit(0.0), lambda a, p: a + p["lon"]) / n

    def moved(p: Column, i: Column) -> Column:
        a, b = F.element_at(points, F.greatest(i, F.lit(1))), F.element_at(points, F.least(i + 2, n))
        x = lambda q: geo.to_x(q["lon"], lat0, lon0)
        y = lambda q: geo.to_y(q["lat"], lat0)
        tx, ty = x(b) - x(a), y(b) - y(a)
        size = F.sqrt(tx * tx + ty * ty)
        nx, ny = x(p) - ty / size * offset, y(p) + tx / size * offset
        still = size < 1e-8
        return F.struct(
            F.when(still, p["lat"]).otherwise(geo.to_lat(ny, lat0)).alias("lat"), F.when(still, p["lon"]).otherwise(geo.to_lon(nx, lat0, lon0)).alias("lon"), p["h"].alias("h")
        )

    return F.transform(points, moved)


def virtual_lanes(roads: DataFrame) -> DataFrame:
    """Each polyline once per lane offset; ids are road_id * 5 + lane."""
    lanes = F.posexplode(F.array(*(F.lit(x) for x in LANE_OFFSETS))).alias("lane", "off")
    spread = roads.where(F.size("points") > 1).select("road_id", "points", lanes)
    return spread.select(
        (F.col("road_id") * len(LANE_OFFSETS) + F.col("lane")).alias("road_id"), F.col("lane").alias("lane_id"), F.col("off").alias("lane_offset"),
        F.concat(F.lit("road_"), F.col("road_id").cast("string"), F.lit("_lane_"), F.col("lane").cast("string")).alias("name"), offset_line(F.col("points"), F.col("off")).alias("points"),
    )


def lane_points(lanes: DataFrame) -> DataFrame:
    """road_id, lane_id, point_id, lat, lon, h, offset_m: the lane table."""
    return lanes.select("road_id", "lane_id", F.posexplode("points").alias("point_id", "p"), "lane_offset").select("road_id", "lane_id", "point_id", "p.lat", "p.lon", "p.h", F.col("lane_offset").alias("offset_m"))


def _cells(low: Column, high: Column, size: float) -> Column:
    return F.sequence(F.floor(low / size), F.floor(high / size))


def grid_join(points: DataFrame, segs: DataFrame, radius: float, cell: float | None = None) -> DataFrame:
    """points x segs within radius of the segment, with obs_dist, s (metres along), px, py (the projection): an equi-join on grid cells. A point
    is in one cell, a segment in all that its box, widened by radius, touches; so no pair comes twice."""
    size = cell or max(radius, 50.0)
    wide = segs.withColumn("cx", F.explode(_cells(F.least("x1", "x2") - radius, F.greatest("x1", "x2") + radius, size)))
    wide = wide.withColumn("cy", F.explode(_cells(F.least("y1", "y2") - radius, F.greatest("y1", "y2") + radius, size)))
    own = points.withColumns({"cx": F.floor(F.col("x") / size), "cy": F.floor(F.col("y") / size)})
    t = geo.along(*(F.col(c) for c in ("x", "y", "x1", "y1", "x2", "y2")))
    out = own.join(wide, ["cx", "cy"]).withColumn("t", t)
    out = out.withColumns({"px": F.col("x1") + (F.col("x2") - F.col("x1")) * F.col("t"), "py": F.col("y1") + (F.col("y2") - F.col("y1")) * F.col("t")})
    out = out.withColumns({"obs_dist": geo.distance(F.col("x"), F.col("y"), F.col("px"), F.col("py")), "s": F.col("t") * F.col("len")})
    return out.where(F.col("obs_dist") <= radius).drop("cx", "cy", "t")


def adjacency(segs: DataFrame, reach: float = StateMachine().adjacent_m) -> DataFrame:
    """seg_id, other: segments with ends within reach, both ways: ends meet in grid cells, no pairs of all segments."""
    ends = segs.select("seg_id", F.explode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("e")).select("seg_id", "e.x", "e.y")
    own = ends.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    near = ends.select(F.col("seg_id").alias("other"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    near = near.withColumn("cx", F.explode(_cells(F.col("ox") - reach, F.col("ox") + reach, reach)))
    near = near.withColumn("cy", F.explode(_cells(F.col("oy") - reach, F.col("oy") + reach, reach)))
    d2 = (F.col("x") - F.col("ox")) * (F.col("x") - F.col("ox")) + (F.col("y") - F.col("oy")) * (F.col("y") - F.col("oy"))
    return own.join(near, ["cx", "cy"]).where((F.col("seg_id") != F.col("other")) & (d2 <= reach * reach)).select("seg_id", "other").distinct()


def near_parallel(segs: DataFrame, degrees: float = StateMachine().cluster_deg, reach: float = StateMachine().cluster_m) -> DataFrame:
    """a, b: segments whose headings differ by degrees at most and whose midpoints lie within reach, a < b."""
    mid = segs.select("seg_id", "heading", ((F.col("x1") + F.col("x2")) / 2).alias("x"), ((F.col("y1") + F.col("y2")) / 2).alias("y"))
    own = mid.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    near = mid.select(F.col("seg_id").alias("b"), F.col("heading").alias("bh"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = near.withColumn("cx", F.explode(_cells(F.col("bx") - reach, F.col("bx") + reach, reach)))
    near = near.withColumn("cy", F.explode(_cells(F.col("by") - reach, F.col("by") + reach, reach)))
    ok = (F.col("seg_id") < F.col("b")) & (geo.angle_diff(F.col("heading"), F.col("bh")) <= math.radians(degrees)) & (geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) <= reach)
    return own.join(near, ["cx", "cy"]).where(ok).select(F.col("seg_id").alias("a"), "b")


def checkpointed(df: DataFrame) -> DataFrame:
    """df written once: its lineage ends here, and a lost executor's part is read again."""
    context = df.sparkSession.sparkContext
    if not context.getCheckpointDir():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not re.match(r"local($|\[)", context.master):
                raise ValueError("spark.checkpoint.dir is unset: executors need a folder that all share")
            import tempfile

            folder = tempfile.mkdtemp(prefix="waymill-")
        context.setCheckpointDir(folder)
    return df.checkpoint()


def components(nodes: DataFrame, edges: DataFrame, rounds: int = 200) -> DataFrame:
    """id, root (the least id within reach) for nodes(id) and edges(a, b): least labels spread along edges, and labels jump to their own
    label's label, until nothing changes."""
    both = checkpointed(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = checkpointed(nodes.select("id", F.col("id").alias("root")))
    for _ in range(rounds):
        best = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("root").alias("seen"))
        new = label.join(best, "id", "left").select("id", F.least("root", "seen").alias("root"), F.col("root").alias("old"))
        jump = new.select(F.col("id").alias("root"), F.col("root").alias("next"))
        new = checkpointed(new.join(jump, "root").select("id", F.least("root", "next").alias("root"), "old"))
        moved = new.where("root <> old").limit(1).count()
        label = new.select("id", "root")
        if not moved:
            return label
    raise RuntimeError("components didn't settle")


def clusters(segs: DataFrame) -> DataFrame:
    """seg_id, cluster (the least seg_id of those that near_parallel joins)."""
    return components(segs.select(F.col("seg_id").alias("id")), near_parallel(segs)).select(F.col("id").alias("seg_id"), F.col("root").alias("cluster"))


def merged_nodes(segs: DataFrame, reach: float = Hmm().merge_m) -> DataFrame:
    """seg_id, u, v: the node of each end. Ends are taken in file order and join the first node within reach, or become one, so the result
    depends on the order; but only ends that chains of such short steps join can meet, and each such group is folded on its own. A node's id
    is that of the end that made it: seg_id * 2 + 0 or 1."""
    ends = segs.select("seg_id", F.posexplode(F.array(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("k", "e"))
    ends = ends.select((F.col("seg_id") * 2 + F.col("k")).alias("id"), "e.x", "e.y")
    own = ends.withColumns({"cx": F.floor(F.col("x") / reach), "cy": F.floor(F.col("y") / reach)})
    near = ends.select(F.col("id").alias("b"), F.col("x").alias("bx"), F.col("y").alias("by"))
    near = near.withColumn("cx", F.explode(_cells(F.col("bx") - reach, F.col("bx") + reach, reach)))
    near = near.withColumn("cy", F.explode(_cells(F.col("by") - reach, F.col("by") + reach, reach)))
    links = own.join(near, ["cx", "cy"]).where((F.col("id") < F.col("b")) & (geo.distance(F.col("x"), F.col("y"), F.col("bx"), F.col("by")) <= reach)).select(F.col("id").alias("a"), "b")
    grouped = ends.join(components(ends.select("id"), links), "id")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        made: list[tuple[int, float, float]] = []
        node = []
        for i, x, y in zip(pdf["id"], pdf["x"], pdf["y"], strict=True):
            hit = next((m for m in made if math.hypot(m[1] - x, m[2] - y) <= reach), None)
            if hit is None:
                hit = (i, x, y)
                made.append(hit)
            node.append(hit[0])
        return pd.DataFrame({"id": pdf["id"], "node": node})

    of = grouped.groupBy("root").applyInPandas(fold, "id long, node long")
    pick = lambda k: F.max(F.when(F.col("id") % 2 == k, F.col("node")))
    return of.groupBy(F.floor(F.col("id") / 2).alias("seg_id")).agg(pick(0).alias("u"), pick(1).alias("v"))


def edges(segs: DataFrame, nodes: DataFrame) -> DataFrame:
    """src, dst, w both ways; segments whose ends merged, or of no length, are none."""
    one = segs.join(nodes, "seg_id").where("u <> v and len >= 1e-8").select("u", "v", "len")
    return one.select(F.col("u").alias("src"), F.col("v").alias("dst"), F.col("len").alias("w")).union(one.select("v", "u", "len")).groupBy("src", "dst").agg(F.min("w").alias("w"))


class Graph:
    """Edges as arrays, for searches on executors."""

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray) -> None:
        by = np.argsort(src, kind="stable")
        self.nodes, self.start = np.unique(src[by], return_index=True)
        self.end = np.r_[self.start[1:], len(src)]
        self.dst, self.w = dst[by], w[by]
        self.at = {int(n): i for i, n in enumerate(self.nodes)}

    def distances(self, source: int, most: float = math.inf, wanted: set[int] | None = None) -> dict[int, float]:
        """Least distance to each node within most; the search ends where it has all that are wanted."""
        done: dict[int, float] = {}
        heap, left = [(0.0, source)], None if wanted is None else set(wanted)
        while heap:
            d, n = heapq.heappop(heap)
            if n in done:
                continue
            done[n] = d
            if left is not None:
                left.discard(n)
                if not left:
                    break
            if (i := self.at.get(n)) is not None:
                for m, w in zip(self.dst[self.start[i] : self.end[i]].tolist(), self.w[self.start[i] : self.end[i]].tolist(), strict=True):
                    if m not in done and d + w <= most:
                        heapq.heappush(heap, (d + w, m))
        return done


def checked(df: DataFrame, most: int = MOST_SEGMENTS) -> pd.DataFrame:
    """A network's table on the driver, refused over `most` rows."""
    rows = df.limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"a network of over {most} rows is cut by region before it is sent to executors")
    return rows


def _sent(edge_table: DataFrame) -> Broadcast[Graph]:
    e = checked(edge_table)
    return edge_table.sparkSession.sparkContext.broadcast(Graph(e["src"].to_numpy(np.int64), e["dst"].to_numpy(np.int64), e["w"].to_numpy(float)))


def wanted_paths(edge_table: DataFrame, pairs: DataFrame, most: float = math.inf) -> DataFrame:
    """src, dst, d of those pairs(src, dst) that a way of at most `most` joins: one search a source, which ends with its last wanted node."""
    graph = _sent(edge_table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for s, wanted in zip(pdf["src"].tolist(), pdf["wanted"].tolist(), strict=True):
                d = graph.value.distances(s, most, set(wanted))
                out += [(s, n, d[n]) for n in wanted if n in d]
            yield pd.DataFrame(out, columns=["src", "dst", "d"])

    return pairs.groupBy("src").agg(F.collect_set("dst").alias("wanted")).mapInPandas(run, "src long, dst long, d double")


def shortest_paths(edge_table: DataFrame, sources: DataFrame, most: float = math.inf) -> DataFrame:
    """src, dst, d from every source(src) to what it reaches within most: one search a source, spread over tasks, on a graph of checked size. The
    result has all pairs; wanted_paths has only those asked for."""
    graph = _sent(edge_table)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for s in pdf["src"].tolist():
                d = graph.value.distances(s, most)
                yield pd.DataFrame({"src": s, "dst": list(d), "d": list(d.values())})

    return sources.select("src").distinct().repartition("src").mapInPandas(run, "src long, dst long, d double")
