"""SimHash near-duplicates by pigeonring filtering.

A text's fingerprint has a bit set where over half of its shingles' XXH64 values have it. Two fingerprints link at `most` or fewer
differing bits. Seen as a ring of m segments, a pair of 64-bit fingerprints with at most `most` differences has, by the pigeonring
principle, a start from which every chain of l consecutive segments differs in at most l * most / m bits, rounded down. So the first
segments, as long as that is 0, are equal, and of the parts of those after them, as long as it is 1, all but one are equal. Each distinct
fingerprint therefore stands under a fixed number of keys (start, the equal segments, all parts but one): eight keys of 24 bits for 3
differences and 4 segments, 32 keys of 12 bits for 7 differences and 16 segments. Pairs under one key are tested chain by chain and only
then over all 64 bits.

Copies collapse before: only distinct fingerprints meet. A key's group yields a spanning forest of its verified links, never its pairs,
and a group over `block` fingerprints is dealt out as pairs of blocks, so no task holds more than two blocks of one key. Components
come from min-label rounds. What is known of each node (its least neighbour, its root) is written before edges meet it, so that both sides
of these joins are plain exchanges and a node with very many edges is dealt to several tasks by the adaptive skew join.

Null text counts as empty; texts without a word have fingerprint 0 and link like any other. Texts of fewer words than a shingle are one.
Rows that repeat, in id or text or both, are rows of their own; a row without an id has a fingerprint and a component like any other, whose
id is null only if no row of it has one.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows, strings

_WEIGHTS = (np.uint64(1) << np.arange(64, dtype=np.uint64)).astype(np.uint64)


def simhash(text: str | None, width: int = 3, distinct: bool = False, seed: int = 42) -> int:
    """The fingerprint, unsigned; of each shingle once only if distinct."""
    words = (text or "").encode().translate(_LOWER).split()
    n = len(words) - width + 1
    if n < 1:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = list(map(b" ".join, zip(*(words[i : n + i] for i in range(width)), strict=True)))
    if not shingles:
        return 0
    if distinct:
        shingles = list(set(shingles))
    h = xxhash.xxh64_intdigest
    hashed = np.array([h(s, seed) for s in shingles], "<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashed), 1 << 16):
        ones += np.unpackbits(hashed[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(_WEIGHTS[2 * ones > len(hashed)].sum(dtype=np.uint64))


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, width: int = 3, distinct: bool = False) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a signed long) for every row of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22):
            fp = np.array([simhash(t, width, distinct) for t in strings(batch)], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


class Ring:
    """The segments of fingerprints and what the principle grants for `most` differences."""

    def __init__(self, most: int = 3, segments: int = 4) -> None:
        self.most, self.segments, self.bits = most, segments, 64 // segments
        if 64 % segments or most >= segments:
            raise ValueError("more segments than differences, and 64 of them at most, each as long")
        budget = [n * most // segments for n in range(segments + 1)]
        equal = max(n for n in range(segments + 1) if budget[n] == 0)
        near = max(n for n in range(segments + 1) if budget[n] <= 1) - equal
        self.equal = min(equal, max(1, 24 // self.bits))  # a key has 32 bits for both
        near = min(near if self.equal == equal else 0, (32 - self.equal * self.bits) // self.bits)
        self.parts = near if near > 1 else 1 + near
        self.part = near * self.bits // self.parts

    def keys(self, fp: Column) -> Column:
        """Key id * 2**32 + the bits that are to be equal, of each start and each part left out."""
        out = []
        head = self.equal * self.bits
        for start in range(self.segments):
            turn = start * self.bits
            turned = F.shiftrightunsigned(fp, turn).bitwiseOR(F.shiftleft(fp, 64 - turn)) if turn else fp
            for off in range(self.parts):
                held = ((1 << head) - 1) | sum(((1 << self.part) - 1) << (head + self.part * i) for i in range(self.parts) if i != off)
                out.append(turned.bitwiseAND(held) + (start * self.parts + off) * (1 << 32))
        return F.array(*out)

    def start(self, key: np.ndarray) -> np.ndarray:
        return (key >> 32) // self.parts

    def linked(self, a: np.ndarray, b: np.ndarray, start: int) -> np.ndarray:
        """Which of the pairs a, b pass the chain of segments from start and then the whole distance."""
        turn = np.uint64(self.bits * start)
        x = a ^ b
        x = (x >> turn) | (x << (np.uint64(64) - turn)) if start else x
        total, ok = np.zeros(x.shape, np.uint8), np.ones(x.shape, bool)
        for i in range(min(self.segments, self.equal + 3)):
            total = total + np.bitwise_count((x >> np.uint64(self.bits * i)) & np.uint64((1 << self.bits) - 1))
            ok &= total <= (i + 1) * self.most // self.segments
        return ok & (np.bitwise_count(x) <= self.most)


def forest(ring: Ring, fps: np.ndarray, start: int, split: int | None = None, rows_at_once: int = 1 << 20) -> list[tuple[int, int]]:
    """Index pairs of verified links that span each component of fps; with split, only links between [:split] and [split:] count."""
    n = len(fps)
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    step = max(1, rows_at_once // max(1, n))
    for low in range(0, n if split is None else split, step):
        own = np.arange(low, min(low + step, n if split is None else split))
        first = low + 1 if split is None else split
        i, j = np.nonzero(ring.linked(fps[own, None], fps[None, first:], start))
        i, j = own[i], j + first
        for x, y in zip(*(k[i < j].tolist() for k in (i, j)), strict=True):
            rx, ry = find(x), find(y)
            if rx != ry:
                parent[max(rx, ry)] = min(rx, ry)
                found.append((x, y))
    return found


def _links(ring: Ring, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, pair, side): spanning links of each (key, pair) group; pair -1 is a whole group, a pair of different blocks has both sides."""
    held: list[np.ndarray] = []  # what is left of the last batch: its last group
    for batch in chain(batches, (None,)):
        if batch is not None:
            held.append(np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "pair", "side", "fp")]))
        if not held:
            continue
        at = np.concatenate(held, axis=1)
        new = np.flatnonzero((np.diff(at[0]) != 0) | (np.diff(at[1]) != 0)) + 1
        if batch is not None:
            if not len(new):
                held = [at]
                continue
            held = [at[:, new[-1] :]]
            at, new = at[:, : new[-1]], new[:-1]
        starts, ends = np.r_[0, new], np.r_[new, at.shape[1]]
        out = []
        size = ends - starts
        two = starts[size == 2]  # most groups: all at once
        fps = at[3].view(np.uint64)
        for s in range(ring.segments):
            own = two[ring.start(at[0][two]) == s]
            own = own[ring.linked(fps[own], fps[own + 1], s)]
            out += zip(at[3][own].tolist(), at[3][own + 1].tolist(), strict=True)
        for low, high in zip(starts[size > 2].tolist(), ends[size > 2].tolist(), strict=True):
            group = fps[low:high]
            sides = at[2][low:high]
            split = int((sides == 0).sum()) if sides[-1] else None
            out += ((int(at[3][low + i]), int(at[3][low + j])) for i, j in forest(ring, group, int(ring.start(at[0][low])), split))
        if batch is None:
            held = []
        if out:
            a, b = np.array(out, np.int64).T
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(fps: DataFrame, ring: Ring, block: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints fps(fp) that connect all that lie within reach of each other."""
    keyed = fps.select("fp", F.explode(ring.keys(F.col("fp"))).alias("key"))
    big = keyed.groupBy("key").count().where(F.col("count") > block).select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    # a fingerprint of a big group stands in every pair of blocks that holds its own; others in the one whole group
    own = F.pmod(F.xxhash64("fp", "key"), F.col("blocks")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            (F.least(F.col("own"), other) * 1000003 + F.greatest(F.col("own"), other)).cast("long").alias("pair"),
            F.when(F.col("own") <= other, 0).otherwise(1).alias("side"),
        ),
    )
    dealt = keyed.join(big, "key", "left").withColumn("own", own)
    dealt = dealt.withColumn("in", F.explode(F.when(F.col("blocks").isNull(), F.array(F.struct(F.lit(-1).cast("long").alias("pair"), F.lit(0).alias("side")))).otherwise(pairs)))
    dealt = dealt.select("key", "fp", "in.pair", "in.side")
    return dealt.repartition("key", "pair").sortWithinPartitions("key", "pair", "side", "fp").mapInArrow(partial(_links, ring), "a long, b long")


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """node, root (the smallest node within reach) for every node of edges(a, b): large-star and small-star rounds until nothing moves."""
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    for _ in range(rounds):
        both = now.union(now.select("v", "u"))
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "cc-least")
        large = materialize(both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "cc-large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "cc-least")
        small = large.join(low, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small, "cc")
        same = {r[0]: (r[1], r[2]) for r in _sums(now).withColumn("k", F.lit(0)).union(_sums(new).withColumn("k", F.lit(1))).select("k", "n", "s").collect()}
        now = new
        if same[0] == same[1]:
            break
    else:
        raise RuntimeError("components didn't settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def shingle_set(text: str | None, width: int = 5) -> np.ndarray:
    """XXH64 values of a text's distinct shingles, rising; a text of fewer words is one shingle, one without words has none."""
    words = (text or "").encode().translate(_LOWER).split()
    found = set(map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))) or ({b" ".join(words)} if words else set())
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(x, 42) for x in found), np.uint64, len(found)))


def alike(sets: list[np.ndarray], least: float, split: int | None = None) -> list[tuple[int, int]]:
    """Index pairs of sets with a Jaccard similarity of `least` or more that span each component of all such pairs; with split, only links
    between [:split] and [split:] count."""
    n = len(sets)
    size = np.array([len(x) for x in sets], np.int64)
    terms, of = np.unique(np.concatenate(sets), return_inverse=True)
    first = np.r_[0, np.cumsum(size)]
    posts = np.repeat(np.arange(n), size)[np.argsort(of, kind="stable")]
    count = np.bincount(of, minlength=len(terms))
    begin = np.r_[0, np.cumsum(count)[:-1]] if len(terms) else count
    label, found = np.arange(n), []
    for i in range(n if split is None else split):
        low = i + 1 if split is None else split
        if not (label[low:] != label[i]).any():
            continue
        own = of[first[i] : first[i + 1]]
        many = count[own]
        at = np.repeat(begin[own] - np.r_[0, np.cumsum(many)[:-1]] if len(own) else many, many) + np.arange(many.sum())
        both = np.bincount(posts[at], minlength=n)
        like = both / np.maximum(size[i] + size - both, 1) >= least
        for j in (np.flatnonzero(like[low:]) + low).tolist():
            if label[j] != label[i]:
                label[label == label[j]] = label[i]
                found.append((i, j))
    return found


def verified_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, most: int = 7, segments: int = 16, block: int = 512, seeds: tuple[int, ...] = (42, 43)) -> DataFrame:
    """doc_id, rid and component for every row of docs(rid, doc_id, text), rid being single and the same at each reading. Components are those of texts with a
    Jaccard similarity of `least` or more over distinct shingles. Fingerprints of distinct words, one for each seed, only choose what is compared: all pairs of
    different texts of one component of links by any of them, which holds every pair within reach. A component over `block` texts is dealt out as pairs of blocks."""
    names = [f"fp{k}" for k in range(len(seeds))]

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22):
            texts = strings(batch)
            fps = [np.array([simhash(t, 1, True, seed) for t in texts], np.uint64).astype(np.int64) for seed in seeds]
            same = np.array([xxhash.xxh3_64_intdigest(shingle_set(t, shingle).tobytes()) for t in texts], np.uint64).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(same), *map(pa.array, fps)], names=["rid", "doc_id", "same", *names])

    def verify(group: pa.Table) -> pa.Table:
        group = group.sort_by([("side", "ascending"), ("same", "ascending")])
        same, side = group.column("same").to_numpy(), group.column("side").to_numpy()
        sets = [shingle_set(t, shingle) for t in group.column("text").to_pylist()]
        found = alike(sets, least, int((side == 0).sum()) if side[-1] else None)
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": same[a], "b": same[b]})

    marked = docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(mark, "rid long, doc_id long, same long, " + ", ".join(f"{n} long" for n in names))
    marked = materialize(marked, "near-rows")
    single = materialize(marked.groupBy("same").agg(F.min(F.struct(*names)).alias("fps"), F.min("rid").alias("rid")).select("same", "rid", "fps.*"), "near-distinct")
    edges = None  # of texts: those of a fingerprint with the first of them, and the first ones of linked fingerprints
    for name in names:
        first = materialize(single.groupBy(F.col(name).alias("fp")).agg(F.min("same").alias("first")), "near-fingerprints")
        found = links(first.select("fp"), Ring(most, segments))
        a, b = first.toDF("a", "of_a"), first.toDF("b", "of_b")
        own = found.join(a, "a").join(b, "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))
        own = own.union(single.join(first, single[name] == first.fp).select(F.col("same").alias("a"), F.col("first").alias("b")).where("a <> b"))
        edges = own if edges is None else edges.union(own)
    member = materialize(components(edges), "near-groups")
    of = member.select(F.col("node").alias("same"), "root").union(member.select("root", "root").toDF("same", "root").distinct())
    grouped = materialize(single.join(of, "same").select("same", "rid", F.col("root").alias("group")), "near-grouped")
    sizes = materialize(grouped.groupBy("group").count().select("group", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "near-sizes")
    asked = grouped.join(sizes, "group").withColumn("own", F.pmod(F.xxhash64("same"), F.col("blocks")).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("blocks") - 1),
        lambda other: F.struct(
            (F.least(F.col("own"), other) * F.lit(1000003).cast("long") + F.greatest(F.col("own"), other)).alias("pair"),
            F.when(F.col("own") <= other, 0).otherwise(1).alias("side"),
        ),
    )
    dealt = docs.select("rid", "text").join(asked, "rid").withColumn("in", F.explode(pairs)).select("group", "in.pair", "in.side", "same", "text")
    linked = dealt.groupBy("group", "pair").applyInArrow(verify, "a long, b long")
    alike_ = materialize(components(linked), "near-components")
    to = alike_.select(F.col("node").alias("same"), "root")
    return marked.join(to, "same", "left").select("doc_id", "rid", F.coalesce("root", "same").alias("component"))


def _sums(edges: DataFrame) -> DataFrame:
    return edges.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")).alias("s"))


def near_duplicates(docs: DataFrame, width: int = 3, distinct: bool = False, most: int = 3, segments: int = 4, block: int = 4096) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id within reach) for every row of docs(doc_id, text)."""
    marked = materialize(fingerprints(docs, width, distinct), "simhash")
    single = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-distinct")
    found = materialize(links(single.select("fp"), Ring(most, segments), block), "simhash-links")
    member = materialize(components(found), "simhash-components")
    of = member.select(F.col("node").alias("fp"), "root").union(member.select("root", "root").toDF("fp", "root").distinct())
    rooted = single.join(of, "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    roots = materialize(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-roots")
    reached = rooted.join(roots, "root").select("fp", "component_id")
    return marked.join(reached, "fp").select("doc_id", "fp", "component_id")
