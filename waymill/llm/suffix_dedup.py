"""Removal of repeated byte strings by suffix arrays.

Every byte goes that is covered by a `size`-byte string which also starts earlier: in a document with a smaller id, or earlier in the same
one. Documents are UTF-8 bytes, matches never cross them, and all strings are judged on the input.

Suffix arrays are built per shard, and what a shard holds is chosen so that equal strings always share one:

1. Anchors. Among every run of size - GRAM + 1 neighbouring GRAM-byte strings, the one with the least hash is an anchor, so every size-byte
   string holds an anchor, and equal strings hold equal ones at equal places. An anchor's context is what all size-byte strings around it
   cover. Contexts that are equal throughout are kept once, by digest: all but the first are covered whole.
2. Shards. Anchors that occur in one context only can have no repeat. The distinct contexts of all others are dealt out by anchor, so that
   shards are independent of each other and as many as the data needs.
3. A task reads its buckets one after another, and a bucket is cut between anchors into shards. In a shard: a suffix array by
   Larsson-Sadakane refinement (prefix doubling in which only unsorted groups are sorted anew), common prefixes by Kasai's rule (a
   suffix's common prefix is one shorter than that of the suffix before it, unless their first bytes differ), and runs of suffixes with a
   common prefix of `size` bytes, in which the earliest stays. An anchor whose contexts are over one shard's size is several shards,
   merged by binary search of the strings of one in the sorted strings of another; it has `hot` contexts at most.
4. An anchor with so many contexts that one task shouldn't hold them (`hot`) goes by the digests of its size-byte strings instead, dealt out
   by digest: exact as well, and even however common the anchor is.

Null text counts as empty. Ids that repeat or are null are put in order first: null ids come before others, rows of one id go by the
hash of their text, and each counts as a document of its own after the ones before.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, rows, text_bytes

SIZE, GRAM, HOT, SHARD, LOCAL = 100, 32, 4096, 1 << 18, 64
PIECE = 1 << 19  # bytes of a long text looked at together
BUCKET = 16384  # contexts of a bucket, on average

_TABLE = np.random.default_rng(20).integers(0, 1 << 63, (2, 256), dtype=np.int64).astype(np.uint64)
_BASE = np.array([0x9E3779B97F4A7C15, 0xD1B54A32D192ED03], np.uint64)
ANCHOR = np.dtype([("h", "u8"), ("c", "u8"), ("rid", "i8"), ("p", "i8"), ("l", "u1"), ("r", "u1"), ("hot", "u1")])
COVER = np.dtype([("rid", "i8"), ("lo", "i8"), ("hi", "i8")])


@lru_cache(4)
def _powers(n: int, base: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    out = []
    for b in (base, inverse):
        x = np.full(n, b, np.uint64)
        x[:1] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


class Hashes:
    """Digests of any stretch of a byte array, from running sums."""

    def __init__(self, a: np.ndarray, which: int = 0) -> None:
        up, self.down = _powers(1 << max(PIECE + 2 * SIZE, len(a)).bit_length(), _BASE[which])
        self.sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum(_TABLE[which][a] * up[: len(a)], out=self.sums[1:])

    def of(self, lo: np.ndarray | slice, hi: np.ndarray | slice) -> np.ndarray:
        sums = self.sums[hi] - self.sums[lo]
        return mix(sums * (self.down[: len(sums)] if isinstance(lo, slice) else self.down[lo]))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding(x: np.ndarray, n: int, f: np.ufunc) -> np.ndarray:
    """f over every n neighbours."""
    width = 1
    while 2 * width <= n:
        x = f(x[width:], x[:-width])
        width *= 2
    return f(x[n - width :], x[: len(x) - (n - width)]) if n > width else x


def find_anchors(a: np.ndarray, starts: np.ndarray, size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, Hashes]:
    """Places and hashes of the anchors of the texts that begin at starts in a."""
    hashes = Hashes(a)
    ends = np.r_[starts[1:], len(a)]
    if len(a) < size:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), hashes
    h = hashes.of(slice(0, len(a) - gram + 1), slice(gram, None))
    key = (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    run = size - gram + 1
    least = _sliding(key, run, np.minimum)  # of each size-byte string
    whole = np.zeros(len(a) + 1, np.int32)
    long = ends - starts >= size
    np.add.at(whole, starts[long], 1)
    np.add.at(whole, ends[long] - size + 1, -1)
    least[np.cumsum(whole)[: len(least)] == 0] = 0
    pad = np.zeros(run - 1, np.uint32)
    best = _sliding(np.concatenate([pad, least, pad]), run, np.maximum)
    p = np.flatnonzero(best == key)
    return p, h[p], hashes


def merged(covers: np.ndarray) -> np.ndarray:
    """COVER rows with overlapping and touching ones joined."""
    if not len(covers):
        return covers
    covers = covers[np.lexsort((covers["lo"], covers["rid"]))]
    rid, lo, hi = covers["rid"], covers["lo"], covers["hi"]
    group = np.cumsum(np.r_[False, rid[1:] != rid[:-1]])
    span = int(hi.max()) + 2
    reach = np.maximum.accumulate(hi + group * span)
    new = np.r_[True, lo[1:] + group[1:] * span > reach[:-1]]
    first = np.flatnonzero(new)
    out = np.zeros(len(first), COVER)
    out["rid"], out["lo"] = rid[first], lo[first]
    out["hi"] = np.maximum.reduceat(hi, first)
    return out


def _pieces(rids: list[int], texts: list[bytes], size: int) -> Iterator[tuple[list[int], list[bytes], list[int], list[tuple[int, int]]]]:
    """Texts in lots of about PIECE bytes; a longer one in pieces that overlap: (rids, bytes, place of the first byte, places that count)."""
    lot: tuple[list, list, list, list] = ([], [], [], [])
    total = 0
    for rid, text in zip(rids, texts, strict=True):
        if len(text) < size:
            continue
        for at in range(0, len(text), PIECE):
            low, high = max(0, at - size), min(len(text), at + PIECE + size)
            for x, v in zip(lot, (rid, text[low:high], low, (at - low, min(len(text), at + PIECE) - low)), strict=True):
                x.append(v)
            total += high - low
            if total >= PIECE:
                yield lot
                lot, total = ([], [], [], []), 0
    if total:
        yield lot


def anchors_of(rids: list[int], texts: list[bytes], size: int = SIZE, gram: int = GRAM) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ANCHOR rows of different contexts, COVER rows of contexts seen before) for each lot of texts."""
    reach = size - gram
    for own, parts, low, counts in _pieces(rids, texts, size):
        sizes = np.array([len(x) for x in parts])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        a = np.frombuffer(b"".join(parts), np.uint8)
        p, h, hashes = find_anchors(a, starts, size, gram)
        of = np.searchsorted(starts, p, "right") - 1
        at = p - starts[of]
        limits = np.array(counts).reshape(-1, 2)
        keep = (at >= limits[of, 0]) & (at < limits[of, 1])
        p, h, of, at = p[keep], h[keep], of[keep], at[keep]
        left, right = np.minimum(at, reach), np.minimum(sizes[of] - at, size)
        out = np.zeros(len(p), ANCHOR)
        out["h"], out["rid"], out["p"], out["l"], out["r"] = h, np.array(own)[of], at + np.array(low)[of], left, right
        out["c"] = mix(hashes.of(p - left, p + right) + (left * 256 + right).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        out = out[np.lexsort((out["p"], out["rid"], out["c"], out["h"]))]
        new = np.r_[True, (out["h"][1:] != out["h"][:-1]) | (out["c"][1:] != out["c"][:-1])][: len(out)]
        yield out[new], merged(_contexts(out[~new]))


def _contexts(anchors: np.ndarray) -> np.ndarray:
    out = np.zeros(len(anchors), COVER)
    out["rid"], out["lo"], out["hi"] = anchors["rid"], anchors["p"] - anchors["l"], anchors["p"] + anchors["r"]
    return out


DEALT = "bucket int, kind int, blob binary"


def _dealt(kind: int, buckets: np.ndarray, data: np.ndarray) -> list[tuple[int, int, bytes]]:
    if not len(data):
        return []
    by = np.argsort(buckets, kind="stable")
    data, buckets = data[by], buckets[by]
    cut = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])[: len(data)]
    return [(int(buckets[i]), kind, data[i:j].tobytes()) for i, j in zip(cut, np.r_[cut[1:], len(data)], strict=True)]


def _out(found: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    cols = zip(*found, strict=True) if found else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(cols, (pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["bucket", "kind", "blob"])


def _blobs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, bytes]]:
    for batch in batches:
        yield from zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("bucket", "kind", "blob")), strict=True)


def _by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[int, list[bytes]]]:
    """The blobs by kind of one bucket after another; rows come sorted by bucket."""
    at, held = None, {}
    for bucket, kind, blob in _blobs(batches):
        if bucket != at:
            if held:
                yield held
            at, held = bucket, {}
        held.setdefault(kind, []).append(blob)
    if held:
        yield held


def _bytes(batch: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    get = lambda c: batch.column(batch.schema.get_field_index(c))
    return get("rid").to_pylist(), [x or b"" for x in get("raw").to_pylist()]


def dealt_anchors(docs: DataFrame, buckets: int, size: int, gram: int, local: int = LOCAL) -> DataFrame:
    """DEALT over docs(rid, raw): kind 0 COVER rows by rid, kind 1 ANCHOR rows by anchor. An anchor with over `local` contexts in one batch of
    texts is hot: its rows are dealt by context, and one, marked 2, tells the anchor's own bucket. A batch sends one row to a bucket, so there
    are no more rows than anchors however many buckets there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22, "raw"):
            lots = list(anchors_of(*_bytes(batch), size, gram))
            if not lots:
                continue
            anchors, covers = (np.concatenate(x) for x in zip(*lots, strict=True))
            anchors = anchors[np.argsort(anchors["h"], kind="stable")]
            first = np.flatnonzero(np.r_[True, anchors["h"][1:] != anchors["h"][:-1]])[: len(anchors)]
            count = np.diff(np.r_[first, len(anchors)])
            hot = np.repeat(count > local, count)
            anchors["hot"] = hot
            marks = anchors[first[count > local]].copy()
            marks["hot"] = 2
            key = np.where(hot, anchors["c"], anchors["h"])
            found = _dealt(1, (np.r_[key, marks["h"]] % np.uint64(buckets)).astype(np.int64), np.concatenate([anchors, marks]))
            yield _out(found + _dealt(0, covers["rid"] % buckets, covers))

    return docs.mapInArrow(run, DEALT)


FOUND = "kind int, rid long, a long, b long, h long"


def settled(dealt: DataFrame, hot: int = HOT) -> DataFrame:
    """FOUND: kind 0 covers (a, b), 1 contexts to compare (a: the anchor's place, b: bytes before it * 256 + bytes from it on), 2 the same, hot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            covers = np.frombuffer(b"".join(held.get(0, [])), COVER)
            x = np.frombuffer(b"".join(held.get(1, [])), ANCHOR)
            held.clear()
            away, x = x[x["hot"] == 1], x[x["hot"] != 1]
            x = x[np.lexsort((x["p"], x["rid"], x["c"], x["h"]))]
            marked = np.isin(x["h"], x["h"][x["hot"] == 2])
            x, marked = x[x["hot"] == 0], marked[x["hot"] == 0]
            same = np.r_[False, (x["h"][1:] == x["h"][:-1]) & (x["c"][1:] == x["c"][:-1])][: len(x)]
            covers = merged(np.concatenate([covers, _contexts(x[same])]))
            x, marked = x[~same], marked[~same]
            first = np.flatnonzero(np.r_[True, x["h"][1:] != x["h"][:-1]])[: len(x)]
            count = np.diff(np.r_[first, len(x)])
            count = np.repeat(count, count)
            burning = marked | (count > hot)
            x, burning = x[(count > 1) | marked], burning[(count > 1) | marked]
            if len(covers):
                yield _found(0, covers["rid"], covers["lo"], covers["hi"], covers["rid"])
            for kind, own in ((1, x[~burning]), (2, np.concatenate([x[burning], away]))):
                if len(own):
                    yield _found(kind, own["rid"], own["p"], own["l"].astype(np.int64) * 256 + own["r"], own["h"].view(np.int64))

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND)


def _found(kind: int, *cols: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), kind, np.int32)), *(pa.array(np.ascontiguousarray(c).astype(np.int64)) for c in cols)], names=["kind", "rid", "a", "b", "h"])


WINDOW = np.dtype([("h", "u8"), ("g", "u8"), ("rid", "i8"), ("p", "i8")])


def dealt_contexts(docs: DataFrame, wanted: DataFrame, buckets: int, size: int) -> DataFrame:
    """DEALT: kind 1 contexts with their bytes by anchor, kind 2 WINDOW digests of hot contexts by digest."""
    by_doc = wanted.groupBy("rid").agg(F.collect_list(F.struct("kind", "a", "b", "h")).alias("wanted"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22, "raw"):
            plain: dict[int, tuple[list, list]] = {}
            out = []
            for rid, raw, want in zip(*_bytes(batch), batch.column(batch.schema.get_field_index("wanted")), strict=True):
                want = want.values
                kind, a, b, h = (want.field(c).to_numpy(zero_copy_only=False) for c in ("kind", "a", "b", "h"))
                lo, hi = a - (b >> 8), a + (b & 255)
                bucket = (h.view(np.uint64) % np.uint64(buckets)).astype(np.int64)
                one = kind == 1
                for to, *head in zip(*(v[one].tolist() for v in (bucket, h, lo, hi)), strict=True):
                    heads, parts = plain.setdefault(to, ([], []))
                    heads.append((head[0], rid, head[1], head[2] - head[1]))
                    parts.append(raw[head[1] : head[2]])
                hot = kind == 2
                if hot.any():
                    starts = np.unique(np.concatenate([np.arange(x, y - size + 1) for x, y in zip(lo[hot], hi[hot], strict=True)]))
                    arr = np.frombuffer(raw, np.uint8)
                    w = np.zeros(len(starts), WINDOW)
                    w["h"], w["g"] = Hashes(arr).of(starts, starts + size), Hashes(arr, 1).of(starts, starts + size)
                    w["rid"], w["p"] = rid, starts
                    out.append(w)
            found = [(k, 1, b"".join([len(heads).to_bytes(8, "little"), np.array(heads, "<i8").tobytes(), *parts])) for k, (heads, parts) in plain.items()]
            if out:
                w = earliest(np.concatenate(out))
                found += _dealt(2, (w["h"] % np.uint64(buckets)).astype(np.int64), w)
            yield _out(found)

    return docs.join(by_doc, "rid").select("rid", "raw", "wanted").mapInArrow(run, DEALT)


def earliest(w: np.ndarray) -> np.ndarray:
    """WINDOW rows by digest, then place."""
    return w[np.lexsort((w["p"], w["rid"], w["g"], w["h"]))]


def suffix_array(t: np.ndarray) -> np.ndarray:
    """By Larsson-Sadakane refinement: sorted by five bytes first, then each unsorted group by the groups that follow it twice as far on."""
    n = len(t)
    if n >= 1 << 20:
        raise ValueError("a shard is under 2**20 bytes")
    if not n:
        return np.zeros(0, np.int64)
    bits, h = np.uint64(20), 5
    wide = np.zeros(n + h, np.uint64)
    wide[:n] = t.astype(np.uint64) + np.uint64(1)  # 0: past the end
    key = np.zeros(n, np.uint64)
    for i in range(h):
        key = key * np.uint64(257) + wide[i : n + i]
    key = np.sort((key << bits) | np.arange(n, dtype=np.uint64))
    sa = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
    start = np.r_[True, (key[1:] >> bits) != (key[:-1] >> bits)]
    rank = np.zeros(n + 1, np.int64)
    rank[n] = -1
    slots = np.arange(n)
    group = np.maximum.accumulate(np.where(start, slots, 0))
    rank[sa] = group
    while True:
        alone = start & np.r_[start[1:], True]
        open_slots = np.flatnonzero(~alone)
        if not len(open_slots):
            return sa
        i = sa[open_slots]
        after = rank[np.minimum(i + h, n)] + 1
        key = np.sort((rank[i].astype(np.uint64) << np.uint64(41)) | (after.astype(np.uint64) << bits) | i.astype(np.uint64))
        i = (key & np.uint64((1 << 20) - 1)).astype(np.int64)
        sa[open_slots] = i
        fresh = np.r_[True, (key[1:] >> bits) != (key[:-1] >> bits)]
        start[open_slots] = fresh
        rank[i] = np.maximum.accumulate(np.where(fresh, open_slots, 0))
        h *= 2


def common_prefixes(t: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """Of each suffix in order with the one before it (0 for the first). Kasai's rule, for all places at once: only where the bytes before two
    neighbours differ is their common prefix compared; elsewhere it is one less than at the place before."""
    n = len(t)
    phi = np.full(n, -1)
    phi[sa[1:]] = sa[:-1]
    p = np.arange(n)
    fresh = (p == 0) | (phi <= 0)
    rest = ~fresh
    fresh[rest] = t[p[rest] - 1] != t[phi[rest] - 1]
    wide = np.zeros(n + 8, np.uint64)
    for i in range(8):
        wide[: max(0, n - i)] |= t[i:].astype(np.uint64) << np.uint64(8 * i)
    at = np.flatnonzero(fresh & (phi >= 0))
    length = np.zeros(len(at), np.int64)
    left = np.arange(len(at))
    while len(left):
        x, y = at[left] + length[left], phi[at[left]] + length[left]
        most = n - np.maximum(x, y)
        d = wide[np.minimum(x, n)] ^ wide[np.minimum(y, n)]
        low = np.where(d == 0, 8, np.bitwise_count((d & (~d + np.uint64(1))) - np.uint64(1)) // 8)
        length[left] += np.minimum(low, most)
        left = left[(low == 8) & (most > 8)]
    reach = np.full(n, -1)
    reach[at] = length + at
    reach[fresh & (phi < 0)] = p[fresh & (phi < 0)]
    plcp = np.maximum(np.maximum.accumulate(reach) - p, 0)
    return plcp[sa]


class Shard:
    """Contexts with their suffix array: the sorted strings of `size` bytes, each once, and where each first starts."""

    def __init__(self, ids: np.ndarray, places: np.ndarray, parts: list[bytes], size: int) -> None:
        """ids, places: order key of the document and place there of each part's first byte."""
        sizes = np.array([len(x) for x in parts])
        starts = np.r_[0, np.cumsum(sizes)[:-1]]
        t = np.frombuffer(b"".join(parts), np.uint8)
        sa = suffix_array(t)
        lcp = common_prefixes(t, sa)
        of = np.repeat(np.arange(len(parts)), sizes)
        inside = np.arange(len(t)) - starts[of]
        whole = inside + size <= sizes[of]
        order = (ids[of] << 40) | (places[of] + inside)
        run = np.cumsum(np.r_[True, lcp[1:] < size]) - 1
        ok = whole[sa]
        sa, run = sa[ok], run[ok]
        begin = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])[: len(sa)]
        self.order, self.begin = order[sa], begin
        self.run = np.cumsum(np.r_[False, run[1:] != run[:-1]])[: len(sa)]
        self.first = np.minimum.reduceat(self.order, begin) if len(begin) else order[:0]
        self.t, self.at, self.size = t, sa[begin], size

    def strings(self) -> np.ndarray:
        """The different strings, in the order of the suffix array. All have one length, so that trailing zeros don't matter."""
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(self.t, self.size)[self.at]).view(f"S{self.size}").ravel() if len(self.at) else np.zeros(0, f"S{self.size}")

    def repeats(self) -> np.ndarray:
        """Order keys of all strings that start earlier too, by what is known of first starts."""
        return self.order[self.order > self.first[self.run]]


def merge(shards: list[Shard]) -> None:
    """Make each shard's first starts those of all shards, by binary search of its strings in the others' sorted ones."""
    found = [s.strings() for s in shards]
    firsts = [s.first.copy() for s in shards]
    for i, s in enumerate(shards):
        for j in range(len(shards)):
            if i != j and len(found[i]) and len(found[j]):
                at = np.minimum(np.searchsorted(found[j], found[i]), len(found[j]) - 1)
                s.first = np.where(found[j][at] == found[i], np.minimum(s.first, firsts[j][at]), s.first)


def compared(rid: np.ndarray, lo: np.ndarray, parts: list[bytes], size: int = SIZE, shard: int = SHARD) -> np.ndarray:
    """COVER rows of the strings of `size` bytes in contexts (document, place of the first byte, bytes) that start earlier too."""
    known, ids = np.unique(rid, return_inverse=True)
    shards, low, total = [], 0, 0
    for i, x in enumerate([*parts, b"\0" * shard]):
        if total and total + len(x) > shard:
            shards.append(Shard(ids[low:i], lo[low:i], parts[low:i], size))
            low, total = i, 0
        total += len(x)
    if len(shards) > 1:
        merge(shards)
    keys = np.concatenate([s.repeats() for s in shards] or [np.zeros(0, np.int64)])
    out = np.zeros(len(keys), COVER)
    out["rid"], out["lo"] = known[keys >> 40] if len(keys) else keys, keys & ((1 << 40) - 1)
    out["hi"] = out["lo"] + size
    return merged(out)


def compared_by_anchor(blobs: list[bytes], size: int = SIZE, shard: int = SHARD) -> Iterator[np.ndarray]:
    """COVER rows of the contexts of a bucket, a lot of whole anchors after another."""
    heads, at = [], []
    for i, blob in enumerate(blobs):
        n = int.from_bytes(blob[:8], "little")
        head = np.frombuffer(blob, "<i8", 4 * n, 8).reshape(n, 4)
        ends = 8 + 32 * n + np.cumsum(head[:, 3])
        heads.append(head)
        at.append(np.stack([np.full(n, i), ends - head[:, 3], ends], 1))
    head, place = np.concatenate(heads), np.concatenate(at)
    by = np.argsort(head[:, 0], kind="stable")
    head, place = head[by], place[by]
    first = np.flatnonzero(np.r_[True, head[1:, 0] != head[:-1, 0]])
    sizes = np.add.reduceat(head[:, 3], first)
    low = total = 0
    for begin, n in zip([*first.tolist(), len(head)], [*sizes.tolist(), shard], strict=True):
        if total and total + n > shard:
            parts = [blobs[i][x:y] for i, x, y in place[low:begin].tolist()]
            yield compared(head[low:begin, 1], head[low:begin, 2], parts, size, shard)
            low, total = begin, 0
        total += n


def compared_covers(dealt: DataFrame, size: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held in _by_bucket(batches):
            for c in compared_by_anchor(held.pop(1), size) if 1 in held else ():
                yield _found(0, c["rid"], c["lo"], c["hi"], c["rid"])
            if 2 in held:
                w = earliest(np.frombuffer(b"".join(held.pop(2)), WINDOW))
                w = w[1:][(w["h"][1:] == w["h"][:-1]) & (w["g"][1:] == w["g"][:-1])]
                c = np.zeros(len(w), COVER)
                c["rid"], c["lo"], c["hi"] = w["rid"], w["p"], w["p"] + size
                c = merged(c)
                yield _found(0, c["rid"], c["lo"], c["hi"], c["rid"])

    return dealt.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, FOUND).select("rid", "a", "b")


def ordered(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, raw (the text's bytes), the columns `keep` as the struct `kept` (if any), and rid: a number of its own for each row in the
    order of documents, the doc_id where ids are single."""
    kept_ = [F.struct(*keep).alias("kept")] if keep else []
    base = docs.select("doc_id", *kept_, F.col("doc_id").cast("long").alias("rid"), text_bytes().alias("raw"))
    n, ids = docs.agg(F.count("*"), F.count_distinct("doc_id")).first()
    if n == ids:
        return base
    by = [F.col("rid").asc_nulls_first(), F.xxhash64("raw")]
    sorted_ = base.repartitionByRange(*by).sortWithinPartitions(*by, "raw")
    kept = materialize(sorted_.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ordered")
    before, total = {}, 0
    for part, count in sorted((r._part, r["count"]) for r in kept.groupBy("_part").count().collect()):
        before[part] = total
        total += count
    offsets = docs.sparkSession.createDataFrame(list(before.items()) or [(0, 0)], "_part int, _before long")
    return kept.join(F.broadcast(offsets), "_part").select("doc_id", *(["kept"] if keep else []), (F.col("_before") + F.col("_at")).alias("rid"), "raw")


def repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """rid, covers (array of struct(lo, hi), any order) of documents(rid, raw) with repeated strings."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(settled(dealt_anchors(docs, 4 * parts, size, gram), hot), "repeat-contexts")
    wanted = found.where("kind > 0")
    n = wanted.count()
    buckets = max(4 * parts, n // BUCKET)
    more = materialize(compared_covers(dealt_contexts(docs, wanted, buckets, size), size), "repeat-covers")
    covers = found.where("kind = 0").select("rid", "a", "b").union(more)
    return covers.groupBy("rid").agg(F.collect_list(F.struct(F.col("a").alias("lo"), F.col("b").alias("hi"))).alias("covers"))


def cut(raw: bytes, lo: np.ndarray, hi: np.ndarray) -> tuple[bytes, str | None, int, int]:
    """The bytes left, the text left (None if nothing went; without the bytes of characters that were cut), how many bytes went, and in how
    many runs."""
    c = np.zeros(len(lo), COVER)
    c["lo"], c["hi"] = lo, hi
    c = merged(c)
    edges = np.r_[0, np.stack([c["lo"], c["hi"]], 1).ravel(), len(raw)]
    left = [raw[i:j] for i, j in edges.reshape(-1, 2).tolist()]
    return b"".join(left), "".join(x.decode("utf-8", "ignore") for x in left) if len(c) else None, int((c["hi"] - c["lo"]).sum()), len(c)


def without_repeats(docs: DataFrame, size: int = SIZE, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, kept (the bytes left), cut_text (what is left as text, null if nothing went), n_bytes, n_removed, n_spans and the columns `keep`
    for every row of docs(doc_id, text). The names of the results can't be among `keep`, which is an error."""
    if not GRAM <= size <= 255:
        raise ValueError(f"size is from {GRAM} to 255 bytes")
    if taken := {"doc_id", "kept", "cut_text", "n_bytes", "n_removed", "n_spans"}.intersection(keep):
        raise ValueError(f"names of results: {sorted(taken)}")
    numbered = ordered(docs, keep)
    covers = repeats(numbered.select("rid", "raw"), size)
    names = ["doc_id", *(["kept"] if keep else [])]
    kinds = dict(numbered.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows(batches, 1 << 22, "raw"):
            out = []
            for raw, covers in zip(batch.column(batch.schema.get_field_index("raw")).to_pylist(), batch.column(batch.schema.get_field_index("covers")), strict=True):
                c = covers.values
                lo, hi = (c.field(x).to_numpy(zero_copy_only=False) for x in ("lo", "hi")) if c is not None else (np.zeros(0, np.int64),) * 2
                out.append((*cut(raw, lo, hi), len(raw)))
            kept, text, removed, spans, n = zip(*out, strict=True) if out else ([],) * 5
            fresh = [pa.array(kept, pa.binary()), pa.array(text, pa.string()), *(pa.array(x, pa.int64()) for x in (n, removed, spans))]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), *fresh], names=[*names, "left", "cut_text", "n_bytes", "n_removed", "n_spans"])

    joined = numbered.join(covers, "rid", "left")
    schema = ", ".join(f"{c} {kinds[c]}" for c in names) + ", left binary, cut_text string, n_bytes long, n_removed long, n_spans long"
    out = joined.select(*names, "raw", "covers").mapInArrow(run, schema)
    return out.select("doc_id", F.col("left").alias("kept"), "cut_text", "n_bytes", "n_removed", "n_spans", *(F.col("kept")[c].alias(c) for c in keep))
