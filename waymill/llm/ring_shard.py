"""Sharding on a consistent-hash ring with virtual nodes and bounded loads.

Each shard owns `vnodes` points of a ring of `slots` places. A row's key (its doc_id; a null id's key is its text) hashes to a slot and
to one of `waves` arrival waves. Rows arrive wave by wave and, within a wave, in ring order; each goes to the first shard clockwise from
its slot that still has room. As capacities count rows, the walk needs no more than the rows per (wave, slot) cell, so the driver replays
it over `slots * waves` counts, a size that doesn't depend on the data, and gets for each cell the shard of every rank interval. Rows
find their rank within their cell with one narrow shuffle (no text in it).

With slack 0 the capacities add up to the number of rows: all shards end full and counts differ by one at most (law `rows`). A larger
slack leaves more rows at home, so fewer move when the number of shards changes, at the price of balance.

Null texts have size 8, like empty ones; repeated rows are rows of their own; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from bisect import bisect_left

import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, text_bytes


def ring(shards: int, vnodes: int = 64, slots: int = 4096) -> list[tuple[int, int]]:
    """(slot, shard) of every virtual node, clockwise; a taken slot passes its node on to the next free one."""
    if shards * vnodes > slots:
        raise ValueError("a ring needs a slot for each virtual node")
    taken: dict[int, int] = {}
    for shard in range(shards):
        for v in range(vnodes):
            at = xxhash.xxh64_intdigest(f"{shard}/{v}") % slots
            while at in taken:
                at = (at + 1) % slots
            taken[at] = shard
    return sorted(taken.items())


def capacities(n: int, shards: int, slack: float = 0.0) -> list[int]:
    if slack > 0:
        return [math.ceil((1 + slack) * n / shards)] * shards
    return [n // shards + (s < n % shards) for s in range(shards)]


def walk(counts: dict[int, int], shards: int, slack: float = 0.0, vnodes: int = 64, slots: int = 4096) -> list[tuple[int, int, int, int, int]]:
    """(cell, first rank, end rank, shard, first slot in the shard) for counts by cell = wave * slots + slot."""
    points = ring(shards, vnodes, slots)
    places = [p for p, _ in points]
    order: list[list[int]] = []  # of each virtual node: the distinct shards clockwise from it
    for i in range(len(points)):
        order.append(list(dict.fromkeys(points[(i + k) % len(points)][1] for k in range(len(points)))))
    room, load, plan = capacities(sum(counts.values()), shards, slack), [0] * shards, []
    for cell in sorted(counts):
        node, low, left = bisect_left(places, cell % slots) % len(points), 0, counts[cell]
        for shard in order[node]:
            if not left:
                break
            if take := min(left, room[shard] - load[shard]):
                plan.append((cell, low, low + take, shard, load[shard]))
                load[shard] += take
                low += take
                left -= take
    return plan


def assign(docs: DataFrame, shards: int = 24, slack: float = 0.0, vnodes: int = 64, slots: int = 4096, waves: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot of every row of docs(doc_id, text)."""
    spark = docs.sparkSession
    raw = text_bytes()
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null/"), F.coalesce("text", F.lit("")))))
    base = materialize(
        docs.select(
            "doc_id",
            (F.octet_length(raw) + 8).cast("long").alias("size"),
            F.crc32(raw).alias("text_crc32"),
            key.alias("key"),
        ).withColumn("cell", (F.pmod(F.shiftrightunsigned("key", 32), F.lit(waves)) * slots + F.pmod("key", F.lit(slots))).cast("int")),
        "ring",
    )
    counts = {r.cell: r["count"] for r in base.groupBy("cell").count().collect()}  # slots * waves rows at most
    plan = spark.createDataFrame(walk(counts, shards, slack, vnodes, slots), "cell int, low long, high long, shard int, first long")
    ranked = base.withColumn("rank", F.row_number().over(Window.partitionBy("cell").orderBy("key", "doc_id", "text_crc32", "size")).cast("long") - 1)
    at = (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high"))
    joined = ranked.join(F.broadcast(plan).withColumnRenamed("cell", "of"), (F.col("cell") == F.col("of")) & at)
    return joined.select("doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("rank") - F.col("low")).alias("slot"))
