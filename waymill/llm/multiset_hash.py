"""Document fingerprints: a homomorphic hash of the multiset of a text's paragraphs.

A paragraph (a line, its line end not included; empty lines are none) hashes to one wide vector and a document's fingerprint is the sum of
its paragraphs' vectors: order doesn't matter, and a paragraph is inserted or deleted by adding or subtracting one vector. The vector has
two parts, each summed modulo its own power of two:

* EXACT lanes of 64 bits (modulo 2**64) from BLAKE2b of the paragraph: equality of paragraph multisets, up to hash collisions;
* NEAR lanes of 32 bits (modulo 2**32): a signed count sketch of the paragraph's word triples. It adds up in the same way, and the cosine
  of two sums estimates that of the two documents' triple counts, which gives a likeness between equal and unrelated.

A fingerprint is written as the hexadecimal digits of all lanes, EXACT ones first, little-endian; read back, it can be compared, updated by
insertion or deletion and added to others. Null text counts as empty; its fingerprint is all zero. Equal texts have equal fingerprints; so
have texts that differ in the order of paragraphs only. Likeness: 1 for equal fingerprints, otherwise the cosine of the NEAR lanes, held to
0..1; 0 if either has no triple. Rows that repeat an id, or have none, are rows of their own, in the order of their texts' hashes; null ids
come first.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EXACT, NEAR = 8, 256


class Sums:
    """A fingerprint in the making. add() and drop() are inverse to one another."""

    __slots__ = ("exact", "near")

    def __init__(self) -> None:
        self.exact, self.near = np.zeros(EXACT, np.uint64), np.zeros(NEAR, np.int32)

    def copy(self) -> Sums:
        new = Sums()
        new.exact, new.near = self.exact.copy(), self.near.copy()
        return new

    def change(self, paragraphs: list[bytes], sign: int) -> Sums:
        digests, triples = [], []
        h = xxhash.xxh3_64_intdigest
        for p in paragraphs:
            digests.append(hashlib.blake2b(p, digest_size=8 * EXACT).digest())
            w = p.split()
            w = [b"", *w, b""] if len(w) > 1 else [b"", *(w or [p]), b""]
            triples += map(b" ".join, zip(w, w[1:], w[2:], strict=False))
        if digests:
            part = np.frombuffer(b"".join(digests), np.uint64).reshape(-1, EXACT).sum(0, dtype=np.uint64)
            self.exact = self.exact + part if sign > 0 else self.exact - part
            hashed = np.fromiter(map(h, triples), np.uint64, len(triples))
            signs = (hashed >> np.uint64(40) & np.uint64(1)).astype(np.int64) * 2 - 1
            part = np.bincount((hashed % np.uint64(NEAR)).astype(np.int64), signs, NEAR).astype(np.int64)
            self.near = (self.near.astype(np.int64) + sign * part).astype(np.int32)
        return self

    def add(self, paragraphs: list[bytes]) -> Sums:
        return self.change(paragraphs, 1)

    def drop(self, paragraphs: list[bytes]) -> Sums:
        return self.change(paragraphs, -1)

    def hex(self) -> str:
        """The fingerprint: all lanes."""
        return (self.exact.astype("<u8").tobytes() + self.near.astype("<i4").tobytes()).hex()

    @classmethod
    def of(cls, written: str) -> Sums:
        """What hex() wrote."""
        raw, new = bytes.fromhex(written), cls()
        new.exact, new.near = np.frombuffer(raw, "<u8", EXACT).copy(), np.frombuffer(raw, "<i4", NEAR, 8 * EXACT).copy()
        return new

    def likeness(self, other: Sums) -> float:
        if np.array_equal(self.exact, other.exact) and np.array_equal(self.near, other.near):
            return 1.0
        a, b = self.near.astype(np.float64), other.near.astype(np.float64)
        n = float(np.dot(a, a)) * float(np.dot(b, b))
        return min(1.0, max(0.0, float(np.dot(a, b)) / n**0.5)) if n else 0.0


def paragraphs(text: str) -> list[bytes]:
    return [p for p in text.encode().split(b"\n") if p]


def fingerprint(text: str | None) -> Sums:
    return Sums().add(paragraphs(text or ""))


def edited(text: str, after: str) -> tuple[str, int]:
    """text with its last quarter replaced by the start of the next one, and the code points that stay."""
    k = len(text) // 4
    keep = len(text) - k
    return text[:keep] + after[:k], keep


def edited_sums(sums: Sums, text: str, new: str, keep: int) -> Sums:
    """The fingerprint of the edited text from that of the text: what lies from the cut line on is deleted, what stands there now is inserted."""
    line = text.rfind("\n", 0, keep) + 1
    return sums.copy().drop(paragraphs(text[line:])).add(paragraphs(new[line:]))


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, extra, id); each is joined with the one after it in its block; extra rows are only that."""
    held = None  # (block, id, text, sums)
    for batch in batches:
        out = []
        cols = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("block", "extra", "doc_id", "text")]
        for block, extra, doc_id, text in zip(*cols, strict=True):
            text = text or ""
            if held and held[0] != block:
                raise ValueError("a block without the first row of the next one")
            if extra and not held:
                continue
            sums = fingerprint(text)
            if held:
                _, held_id, old, old_sums = held
                new, keep = edited(old, text)
                changed = edited_sums(old_sums, old, new, keep)
                out.append((held_id, len(old), hashlib.sha256(new.encode()).hexdigest(), old_sums.hex(), changed.hex(), old_sums.likeness(changed), old_sums.likeness(sums)))
            held = None if extra else (block, doc_id, text, sums)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), ARROW, strict=True)] if out else [pa.array([], f.type) for f in ARROW], schema=ARROW)


def next_edits(docs: DataFrame, blocks_per_partition: int = 4) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text), the next document being that of the next larger doc_id (null ids first, repeated ids in
    the order of their texts' hashes), the first for the last.

    Ids are cut into blocks at quantiles, and an id (or null) with more rows than a block should have is cut again by its texts' hashes; each
    block also gets the first row of the next block, so texts move once and no task holds more than its blocks. Only block bounds and the
    ids that are cut again, no more than blocks, reach the driver. Rows alike in id and text stay together.
    """
    spark = docs.sparkSession
    tie = F.xxhash64("text")
    base = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(F.col("doc_id").cast("double"), F.lit(-float("inf"))).alias("id"), tie.alias("tie"))
    blocks = blocks_per_partition * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows_ = base.count()
    # ids with more rows than two blocks, and how many parts they are cut into: under `blocks` of them
    often = [(r["id"], -(-r["count"] * blocks // rows_)) for r in base.groupBy("id").count().where(F.col("count") > 2 * rows_ // blocks + 1).collect()]
    cuts = base.where("doc_id is not null").approxQuantile("id", [i / blocks for i in range(1, blocks)], 0.2 / blocks) if blocks > 1 else []
    alone = [x for id_, _ in often for x in (id_, math.nextafter(id_, math.inf))]  # each such id is a cut of its own
    splits = sorted({-float("inf"), *cuts, *alone, float("inf")})
    if len(splits) > 2:
        plain = Bucketizer(splits=splits, inputCol="id", outputCol="cut").transform(base).withColumn("cut", F.col("cut").cast("int"))
    else:
        plain = base.withColumn("cut", F.lit(0))
    parts = spark.createDataFrame(often, "id double, parts int")
    plain = plain.join(F.broadcast(parts), "id", "left").drop("id")
    plain = plain.withColumn("part", F.coalesce(F.floor((F.col("tie").cast("double") / 2.0**64 + 0.5) * F.col("parts")).cast("int"), F.lit(0)))
    least = F.min(F.struct(F.col("doc_id").isNotNull(), "doc_id", "tie")).alias("m")
    bounds = sorted(plain.groupBy("cut", "part").agg(least).select("cut", "part", "m.doc_id", "m.tie").collect(), key=lambda r: r[:2])
    number = spark.createDataFrame([(i, *r[:2]) for i, r in enumerate(bounds)], "block int, cut int, part int")
    follow = spark.createDataFrame([(*r[2:], i - 1 if i else len(bounds) - 1) for i, r in enumerate(bounds)], "first long, first_tie long, into int")
    extra = base.join(F.broadcast(follow), F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("tie") == F.col("first_tie")))
    extra = extra.select("doc_id", "text", F.col("into").alias("block"), F.lit(1).alias("extra"), "tie")
    own = plain.join(F.broadcast(number), ["cut", "part"]).select("doc_id", "text", "block", F.lit(0).alias("extra"), "tie")
    both = own.union(extra.dropDuplicates(["block"]) if often else extra)
    dealt = both.repartition("block").sortWithinPartitions("block", "extra", F.col("doc_id").asc_nulls_first(), "tie").drop("tie")
    return dealt.mapInArrow(_chain, SCHEMA)
