"""Best-fit packing by large-item matching.

Documents become token ids and a closing id; only those longer than a sequence are cut, from their end, into full pieces, so that the
first piece is the short one. Lengths are whole numbers up to the capacity, so packing needs no more than how many pieces have each
length: the driver packs that histogram, a size that doesn't grow with the data.

* Large pieces, over a third of the capacity, stand at most two to a sequence. Greedy matching from the longest down gives each the
  longest free partner that fits, which leaves the fewest sequences that two to a sequence can give.
* Smaller pieces, longest first, go to the smallest gap that takes them, and to a new sequence where none does.

The result is a plan of rank intervals by length. Pieces find their rank by (length, salt) cells, a length having as many salts as its share
of CELLS, so that no length, however common, is ranked in one task, and look their interval up by binary search.

Null text counts as empty: one piece, the closing id alone. Rows that repeat, in id or text or both, and rows without an id are packed each
on its own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, rows, strings

CELLS = 1 << 16


@lru_cache(2)
def encoder(path: str, ranks: str, pattern: str):
    """texts -> id arrays as the tokenizers file gives them; by tiktoken on the same vocabulary, which is five times as fast."""
    import tiktoken
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    special = {t.content: i for i, t in library.get_added_tokens_decoder().items()}
    with open(ranks, "rb") as f:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=table, special_tokens=special)
    allowed = set(special)

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special=allowed, disallowed_special=())
        except Exception as e:  # its matcher gives up on some very long runs; the library doesn't
            if "stack" not in str(e).lower() and "backtrack" not in str(e).lower():
                raise
            return np.array(library.encode(text, add_special_tokens=False).ids, np.uint32)

    return encode


def pieces(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece."""
    n = len(ids)
    first = n % capacity or min(n, capacity)
    return [(0, first), *((at, capacity) for at in range(first, n, capacity))]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cut(docs: DataFrame, path: str, ranks: str, pattern: str, capacity: int = 2048, close: int = 0, keep_ids: bool = False) -> DataFrame:
    """PIECES (and ids, if they are to be kept) of docs(doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path, ranks, pattern)
        for batch in rows(batches, 1 << 22):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), strings(batch), strict=True):
                ids = np.append(encode(text), np.uint32(close)).astype("<u4")
                for i, (at, n) in enumerate(pieces(ids, capacity)):
                    own = ids[at : at + n]
                    out.append((doc_id, i, at, n, zlib.crc32(own.tobytes())) + ((own,) if keep_ids else ()))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=False)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 5 + keep_ids])

    return docs.select(docs.doc_id.cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + ", ids array<int>" * keep_ids)


def pack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(number of sequences, [(length, copies), ...]) for counts by length; together they hold every piece once."""
    left = dict(counts)
    large = sorted((s for s in left if 3 * s > capacity), reverse=True)
    groups: dict[int, list[tuple[int, list[tuple[int, int]]]]] = defaultdict(list)  # by gap

    for size in large:
        for partner in (p for p in large if p <= size and p <= capacity - size):
            if not left[size]:
                break
            pairs = left[size] // 2 if partner == size else min(left[size], left[partner])
            if pairs:
                groups[capacity - size - partner].append((pairs, [(size, 1), (partner, 1)]))
                left[size] -= pairs
                left[partner] -= pairs
        if left[size]:
            groups[capacity - size].append((left[size], [(size, 1)]))
            left[size] = 0

    gaps = sorted(g for g in groups if g)
    for size in sorted((s for s in left if 3 * s <= capacity), reverse=True):
        need = left[size]
        fits = [g for g in gaps if g >= size]
        for gap in fits:
            per = gap // size
            while need and groups[gap]:
                n, held = groups[gap].pop()
                full = min(n, need // per)
                if full:
                    groups[gap - per * size].append((full, [*held, (size, per)]))
                    need -= full * per
                if full < n:
                    rest = n - full
                    if need:  # fewer than fill one gap
                        groups[gap - need * size].append((1, [*held, (size, need)]))
                        need, rest = 0, rest - 1
                    if rest:
                        groups[gap].append((rest, held))
            if not need:
                break
        if need:
            per = capacity // size
            if need // per:
                groups[capacity - per * size].append((need // per, [(size, per)]))
            if need % per:
                groups[capacity - need % per * size].append((1, [(size, need % per)]))
        gaps = sorted(g for g, held in groups.items() if g and held)
    return [group for gap in sorted(groups) for group in groups[gap]]


def intervals(plan: list[tuple[int, list[tuple[int, int]]]]) -> np.ndarray:
    """Rows (length, first rank, end rank, first sequence, copies, offset), sorted."""
    out, used, base = [], defaultdict(int), 0
    for n, held in plan:
        at = 0
        for size, copies in held:
            out.append((size, used[size], used[size] + n * copies, base, copies, at))
            used[size] += n * copies
            at += size * copies
        base += n
    return np.array(sorted(out), np.int64).reshape(-1, 6)


def place(table: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of pieces by length and rank."""
    starts = table[:, 0].astype(np.float64) * 2.0**40 + table[:, 1] if len(table) and table[:, 2].max() < 2**40 else None
    if starts is not None and table[:, 2].max() < 2**41 and table[:, 0].max() < 2**12:
        i = np.searchsorted(starts, length.astype(np.float64) * 2.0**40 + rank, "right") - 1
    else:  # exact for any number of pieces
        i = np.empty(len(length), np.int64)
        for size in np.unique(length):
            low = np.searchsorted(table[:, 0], size)
            high = np.searchsorted(table[:, 0], size, "right")
            own = length == size
            i[own] = low + np.searchsorted(table[low:high, 1], rank[own], "right") - 1
    row = table[i]
    step = rank - row[:, 1]
    return row[:, 3] + step // row[:, 4], row[:, 5] + step % row[:, 4] * length


def packed(cut_pieces: DataFrame, capacity: int = 2048, cells: int = CELLS, least: int = 512) -> DataFrame:
    """The columns of cut_pieces (PIECES, stored) with sequence_id and offset."""
    counts = {r.length: r["count"] for r in cut_pieces.groupBy("length").count().collect()}  # `capacity` rows at most
    cell = max(least, sum(counts.values()) // cells)
    salts = [-(-counts.get(n, 1) // cell) for n in range(capacity + 1)]
    of_length = F.element_at(F.array(*map(F.lit, salts)), F.col("length").cast("int") + 1)
    salted = cut_pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), of_length).cast("int"))
    first = np.r_[0, np.cumsum(salts)]  # the cell of each length's first salt
    base = np.zeros(first[-1], np.int64)
    for r in salted.where(of_length > 1).groupBy("length", "salt").count().collect():  # `cells` and `capacity` rows at most
        if r.salt + 1 < salts[r.length]:
            base[first[r.length] + r.salt + 1] = r["count"]
    for n in np.flatnonzero(np.array(salts) > 1):
        base[first[n] : first[n + 1]] = np.cumsum(base[first[n] : first[n + 1]])
    table = intervals(pack(counts, capacity))
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")).cast("long") - 1)
    names = cut_pieces.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt", "rank"))
            sequence, offset = place(table, length, rank + base[first[length] + salt])
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in names), pa.array(sequence), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{n} {t}" for n, t in cut_pieces.dtypes)
    return ranked.select(*names, "salt", "rank").mapInArrow(run, kinds + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, ranks: str, pattern: str, capacity: int = 2048, close: int = 0) -> DataFrame:
    """PIECES, sequence_id and offset of every row of docs(doc_id, text)."""
    return packed(materialize(cut(docs, path, ranks, pattern, capacity, close), "pieces"), capacity)
