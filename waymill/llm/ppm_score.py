"""Language-model scoring by prediction by partial matching over bytes.

Both models see texts with A-Z in lower case. The model is a trie of byte contexts up to `order` bytes long with the counts of what follows each, over all training texts (each opened by
start symbols and closed by an end symbol, which is coded too). A symbol is coded in the longest context known: with probability
(c - 1/2) / t where it was seen there (c of t times, q different symbols), otherwise an escape, q / 2t, leads to the context one
byte shorter, in which the symbols of the longer one are excluded (from c, t and q there); under the empty context all symbols left are alike. Every context that
training texts have is known, so the model grows with the corpus, and no place holds it whole: each block of rows sends its distinct
(context, symbol) codes with their training counts, cut into buckets by the last bytes of the context, and gets back the logarithms of just
those codes. A bucket has all of the contexts that end in the same SUFFIX bytes, of any block, so it works out their probabilities by
itself; only the counts of shorter contexts, which the alphabet bounds and not the corpus, go to all buckets.

The base is an add-0.1 unigram model over words, whose table grows with the corpus. It goes the same way: each block sends its distinct words
(as 64-bit hashes) with their training counts, cut into buckets by hash, and gets back the corpus counts of just those words. A word,
however common, is one number of a block.

A block is about BLOCK bytes of text, by the place of rows in their partition; a text of BLOCK / 4 bytes or more is a block of its own. The
table is read twice and has to give rows the same blocks each time, as stored files do; if it doesn't, it is an error. Null text counts as empty: one end token. With nothing to train on, all symbols are alike (score) and the
base falls to its formula with N = V = 0. A null id counts as the empty text for the training split; rows that repeat, in id or text or
both, are rows of their own, each learned from and scored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize, rows, trim

END, SYMBOLS, WIDE = 256, 257, 9
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BLOCK = 12 << 20  # bytes of text
SUFFIX = 3  # bytes of context that contexts of a bucket share


def lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes one after another, A-Z in lower case, and the size of each; null as empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    return _LOWER[data[offsets[0] : offsets[-1]]], np.diff(offsets)


def symbols(texts: list[str] | pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts' symbols, each text with `order` start symbols and an end, and where each text ends."""
    data, sizes = lowered(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string()))
    out = np.full(len(data) + len(sizes) * (order + 1), END, np.int16)
    ends = np.cumsum(sizes + order + 1)
    at = 0
    for end, n in zip(ends.tolist(), sizes.tolist(), strict=True):
        out[end - 1 - n : end - 1] = data[at : at + n]
        at += n
    return out, ends


def codes(s: np.ndarray, order: int) -> np.ndarray:
    """The packed windows of order + 1 symbols of s."""
    code = np.zeros(max(0, len(s) - order), np.int64)
    for i in range(order + 1):
        code <<= WIDE
        code |= s[i : len(s) - order + i]
    return code


def coded(texts: list[str] | pa.Array, order: int, most: int = 1 << 17) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of all symbols that are coded, and the text of each, `most` symbols at a time."""
    s, ends = symbols(texts, order)
    starts = np.r_[0, ends[:-1]][: len(ends)]
    inside = np.ones(len(s), bool)  # start symbols are given, not coded
    for i in range(order):
        inside[starts + i] = False
    for low in range(order, len(s), most):
        high = min(len(s), low + most)
        first, last = np.searchsorted(ends, (low, high - 1), "right").tolist()
        cuts = np.clip(np.r_[starts[first : last + 1], high], low, high)
        own = inside[low:high]
        yield codes(s[low - order : high], order)[own], np.repeat(np.arange(first, last + 1), np.diff(cuts))[own]


def distinct(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different numbers, rising, and how often each stands in x."""
    x = np.sort(x)
    first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]][: len(x)])
    return x[first], np.diff(np.r_[first, len(x)])


def grams(texts: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context and symbol, count), packed WIDE bits a symbol, the latest lowest."""
    return distinct(np.concatenate([np.zeros(0, np.int64), *(code for code, _ in coded(texts, order))]))


def words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words of the texts, which of them each word is, and which text it is in."""
    data, sizes = lowered(texts)
    whole = pa.LargeStringArray.from_buffers(len(sizes), pa.py_buffer(np.r_[0, np.cumsum(sizes)]), pa.py_buffer(data))
    split = pc.ascii_split_whitespace(whole)
    flat, of = split.flatten(), pc.list_parent_indices(split).to_numpy()
    some = pc.not_equal(pc.binary_length(flat), 0)  # white space at an edge leaves an empty one
    flat, of = flat.filter(some).dictionary_encode(), of[some.to_numpy(zero_copy_only=False)]
    found = flat.dictionary.cast(pa.large_binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, found), np.uint64, len(found)).view(np.int64)
    return hashes, flat.indices.to_numpy().astype(np.int32), of.astype(np.int32)


def _packed(x: np.ndarray) -> bytes:
    """Differences of integers by planes of bytes, which compresses well."""
    return np.diff(x, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(x, np.uint8).reshape(8, -1).T.copy().view("<i8").ravel())


def _buckets(kind: int, code: np.ndarray, order: int, buckets: int) -> np.ndarray:
    if kind == WORDS:
        return ((code.view(np.uint64) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    suffix = (code >> WIDE) & ((1 << WIDE * min(order, SUFFIX)) - 1)
    return ((suffix.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) % buckets


def _summed(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both, at = np.unique(code, return_inverse=True)
    return both, np.bincount(at, n, len(both)).astype(np.int64)


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of several (rising numbers, counts)."""
    code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    by = np.argsort(code, kind="stable")  # runs that are sorted already
    code, n = code[by], n[by]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][: len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _add(held: list[tuple[np.ndarray, np.ndarray]], *parts: tuple[np.ndarray, np.ndarray]) -> None:
    """Append parts, merged from time to time."""
    held += parts
    if len(held) > 12:
        held[:] = [_merged(held)]


GRAMS, WORDS = 0, 1
ASKED = "block long, kind int, bucket long, code binary, n binary"


def blocks(docs: DataFrame, train_where: Column, rows_: int, long: int = BLOCK // 4) -> DataFrame:
    """doc_id, text, train and block of every row of docs(doc_id, text)."""
    at = F.monotonically_increasing_id()
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(train_where, F.lit(False)).alias("train"), at.alias("at"))
    block = F.when(F.coalesce(F.octet_length("text"), F.lit(0)) < long, F.shiftright("at", max(1, rows_).bit_length() - 1)).otherwise(-F.col("at") - 1)
    return own.withColumn("block", block).drop("at")


def block_counts(blocked: DataFrame, order: int, buckets: int) -> DataFrame:
    """ASKED over blocks(): codes (GRAMS) and hashes (WORDS) that stand in a block, rising, and how often in its training texts, both packed. A
    block whose rows don't come together has several rows for a bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)

        for batch in rows(batches, 1 << 22):
            block, learn = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("block", "train"))
            text = batch.column(batch.schema.get_field_index("text"))
            turn = np.argsort(block, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(block[turn]) != 0, True])
            for low, high in zip(edges, edges[1:], strict=False):
                own, train, at = text.take(pa.array(turn[low:high])), learn[turn[low:high]], int(block[turn[low]])
                for code, of in coded(own, order):
                    learned = train[of]
                    asked, n = distinct(code[~learned])
                    _add(held[at, GRAMS], distinct(code[learned]), (asked, np.zeros_like(n)))
                hashes, which, of = words(own)
                by = np.argsort(hashes)
                _add(held[at, WORDS], (hashes[by], np.bincount(which, train[of], len(hashes)).astype(np.int64)[by]))
            for key in [k for k in held if k[0] != block[-1]]:
                yield _asked(*key, *_merged(held.pop(key)), order, buckets)
            trim()
        for key, found in held.items():
            yield _asked(*key, *_merged(found), order, buckets)

    return blocked.select("block", "train", "text").mapInArrow(run, ASKED)


def _asked(block: int, kind: int, code: np.ndarray, n: np.ndarray, order: int, buckets: int) -> pa.RecordBatch:
    of = _buckets(kind, code, order, buckets)
    by = np.argsort(of, kind="stable")
    present, first = np.unique(of[by], return_index=True)
    parts = np.split(by, first[1:]) if len(present) else []
    cols = [np.full(len(present), block, np.int64), np.full(len(present), kind, np.int32), present]
    return pa.RecordBatch.from_arrays([*map(pa.array, cols), *(pa.array([_packed(x[i]) for i in parts], pa.binary()) for x in (code, n))], names=["block", "kind", "bucket", "code", "n"])


def short_counts(grams_: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """The (context and symbol, count) arrays of contexts of under min(order, SUFFIX) bytes, from block_counts; the alphabet bounds their size."""
    longest = min(order, SUFFIX) - 1
    if longest < 0:
        return []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for c, m in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                c, m = _unpacked(c), _unpacked(m)
                c, m = _summed(c[m > 0] & ((1 << WIDE * (longest + 1)) - 1), m[m > 0])
                held.append((c, m))
                if len(held) == 256:
                    code, n = _summed(np.concatenate([code, *(x[0] for x in held)]), np.concatenate([n, *(x[1] for x in held)]))
                    held.clear()
        code, n = _summed(np.concatenate([code, *(x[0] for x in held)]), np.concatenate([n, *(x[1] for x in held)]))
        yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(n)], names=["code", "n"])

    got = grams_.where(F.col("kind") == GRAMS).select("code", "n").mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).toArrow()
    code, n = (got.column(c).to_numpy().astype(np.int64) for c in ("code", "n"))
    return [_summed(code & ((1 << WIDE * (j + 1)) - 1), n) for j in range(longest + 1)]


def _found(table: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where x stand in a sorted table, and whether they do."""
    if not len(table):
        return np.zeros(len(x), np.int64), np.zeros(len(x), bool)
    at = np.minimum(np.searchsorted(table, x), len(table) - 1)
    return at, table[at] == x


def log_probabilities(code: np.ndarray, n: np.ndarray, order: int, short: list[tuple[np.ndarray, np.ndarray]], discount: float = 0.5) -> np.ndarray:
    """log10 of the probability of each code's symbol after its context. Codes are distinct and rising and have, with their counts (0: only
    asked for), all that training has of contexts that end in the same bytes; short: the counts of shorter contexts, over all of training."""
    p = np.full(len(code), 1 / SYMBOLS)
    below = p  # of a symbol that a context has not seen, after its escape
    last = None
    for j in range(order + 1):
        seen, c = short[j] if j < len(short) else _summed(code[n > 0] & ((1 << WIDE * (j + 1)) - 1), n[n > 0])
        contexts, at = np.unique(seen >> WIDE, return_inverse=True)
        t, q = np.bincount(at, c, len(contexts)), np.bincount(at, minlength=len(contexts))
        i, known = _found(contexts, (code >> WIDE) & ((1 << WIDE * j) - 1))
        k, there = _found(seen, code & ((1 << WIDE * (j + 1)) - 1))
        if not known.any():
            break
        own = np.where(there, c[k], 0)
        if last is None:
            below = np.full(len(code), 1 / max(1, SYMBOLS - int(q[0])))
        else:
            old_seen, old_c, old_contexts, old_t, old_q, old_own = last
            shorter, _ = _found(old_contexts, contexts & ((1 << WIDE * (j - 1)) - 1))
            up = old_c[_found(old_seen, seen & ((1 << WIDE * j) - 1))[0]]
            left = np.maximum(old_t[shorter] - np.bincount(at, up, len(contexts)), 0)  # of symbols of the shorter context that this one has not seen
            fall = np.where(left > 0, discount * (old_q[shorter] - q) / np.maximum(left, 1), 1.0)
            below = np.where(known, np.where(old_own > 0, (old_own - discount) / np.maximum(left[i], 1), fall[i] * below), below)
        full = q[i] == SYMBOLS  # nothing is left to escape to
        p = np.where(known, np.where(own > 0, np.where(full, own, own - discount) / t[i], discount * q[i] / t[i] * below), p)
        last = seen, c, contexts, t, q, own
    return np.log10(p.clip(1e-300))


ANSWERED = "block long, kind int, bucket long, answer binary, v long, n long"


def answers(asked: DataFrame, order: int) -> DataFrame:
    """ANSWERED: for the codes of a block and bucket of block_counts, as they stand there, logarithms (float32), for its hashes counts (int64).
    v and n, on one row of a bucket of words: its different words in training texts, and all of them."""
    short = short_counts(asked, order)

    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.select(["block", "code", "n"]).combine_chunks().sort_by("block")
        block = table.column("block").to_numpy()
        code = [_unpacked(x) for x in table.column("code").to_pylist()]
        both, at = np.unique(np.concatenate(code), return_inverse=True)
        n = np.bincount(at, np.concatenate([_unpacked(x) for x in table.column("n").to_pylist()]), len(both)).astype(np.int64)
        v = total = 0
        if key[0].as_py() == GRAMS:
            answer = log_probabilities(both, n, order, short).astype("<f4")
        else:
            answer, v, total = n.astype("<i8"), np.count_nonzero(n), int(n.sum())
        ends = np.cumsum([len(x) for x in code])
        first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        last = np.r_[first[1:], len(block)]
        out = []
        for i, j in zip(first.tolist(), last.tolist(), strict=True):
            own = at[ends[i] - len(code[i]) : ends[j - 1]]
            out.append(answer[own if j == i + 1 else np.unique(own)].tobytes())
        m = len(out)
        cols = [block[first], np.full(m, key[0].as_py(), np.int32), np.full(m, key[1].as_py()), out, np.r_[v, np.zeros(m - 1, np.int64)], np.r_[total, np.zeros(m - 1, np.int64)]]
        return pa.table(dict(zip(("block", "kind", "bucket", "answer", "v", "n"), cols, strict=True)))

    return asked.groupBy("kind", "bucket").applyInArrow(run, ANSWERED)


class Logs:
    """Logarithms by code: a table of slots, and binary search for codes whose slot another one took."""

    def __init__(self, code: np.ndarray, logs: np.ndarray) -> None:
        self.code, self.logs = code, logs
        self.shift = np.uint64(62 - max(1, len(code)).bit_length())
        self.slots = np.zeros(1 << (64 - int(self.shift)), np.int32)
        self.slots[self._slot(code)] = np.arange(len(code), dtype=np.int32)

    def _slot(self, code: np.ndarray) -> np.ndarray:
        return ((code.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def of(self, code: np.ndarray) -> np.ndarray:
        out = np.empty(len(code), self.logs.dtype)
        for low in range(0, len(code), 1 << 15):  # what fits the cache
            own = code[low : low + (1 << 15)]
            at = self.slots[self._slot(own)]
            other = np.flatnonzero(self.code[at] != own)
            at[other] = np.searchsorted(self.code, own[other])
            out[low : low + len(own)] = self.logs[at]
        return out


@dataclass
class Trie:
    """The same model of a corpus that fits in memory, which tests compare with: tables over states (known contexts, 0 the empty one) and classes of symbols."""

    order: int
    classes: np.ndarray  # of each symbol
    move: np.ndarray  # state, class -> state
    logp: np.ndarray  # state, class -> log10 of the probability of one symbol

    def score(self, texts: list[str]) -> np.ndarray:
        """log10 of each text's probability, its end included."""
        if not texts:
            return np.zeros(0)
        s, ends = symbols(texts, self.order)
        c = self.classes[s]
        k, wide = self.order, self.move.shape[1]
        out = np.zeros(len(s))
        move, logp = self.move.ravel(), self.logp.ravel()
        for at in range(k, len(s), 1 << 20):
            end = min(len(s), at + (1 << 20))
            state = np.zeros(end - at, np.int32)
            for i in range(k, 0, -1):
                state = move.take(state * wide + c[at - i : end - i])
            out[at:end] = logp.take(state * wide + c[at:end])
        starts = np.r_[0, ends[:-1]]
        for i in range(k):  # start symbols are given, not coded
            out[starts + i] = 0
        return np.add.reduceat(out, starts)


def build(levels: list[tuple[np.ndarray, np.ndarray]], order: int, discount: float = 0.5) -> Trie:
    """A trie from the (context and symbol, count) arrays of contexts of 0..order bytes, whole contexts only; counts are 1 or more."""
    seen = np.unique(levels[0][0]) if levels and len(levels[0][0]) else np.zeros(0, np.int64)
    classes = np.full(SYMBOLS, len(seen), np.int32)
    classes[seen] = np.arange(len(seen))
    rest = SYMBOLS - len(seen)
    wide = len(seen) + (rest > 0)
    if not len(seen):
        return Trie(order, classes, np.zeros((1, 1), np.int32), np.full((1, 1), -np.log10(SYMBOLS)))
    contexts, first, total = [np.zeros(1, np.int64)], [0], 1
    for j in range(1, order + 1):
        contexts.append(np.unique(levels[j][0] >> WIDE))
        first.append(total)
        total += len(contexts[j])
    move, logp = np.zeros((total, wide), np.int32), np.zeros((total, wide), np.float32)
    below = np.full((total, wide), 1 / rest if rest else 1.0, np.float32)  # of symbols that a context has not seen, after its escape
    own_counts = np.zeros((0, 0))
    for j in range(order + 1):
        code, n = levels[j]
        state = np.searchsorted(contexts[j], code >> WIDE)
        counts = np.zeros((len(contexts[j]), wide))
        counts[state, classes[code & 511]] = n
        t, q = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        span = slice(first[j], first[j] + len(contexts[j]))
        if j:
            shorter = np.searchsorted(contexts[j - 1], contexts[j] & ((1 << WIDE * (j - 1)) - 1))
            move[span] = move[first[j - 1] + shorter]
            up = own_counts[shorter] * (counts == 0)
            left, kinds = up.sum(1, keepdims=True), (up > 0).sum(1, keepdims=True)
            whole = np.maximum(left, 1)
            fall = np.where(left > 0, discount * kinds / whole, 1.0)
            below[span] = np.where(up > 0, (up - discount) / whole, fall * below[first[j - 1] + shorter])
        full = q == (SYMBOLS if rest > 1 else wide)  # nothing is left to escape to
        logp[span] = np.log10(np.where(counts > 0, np.where(full, counts, counts - discount) / t, discount * q / t * below[span]).clip(1e-38))
        if j < order:
            child = contexts[j + 1]
            parent = np.searchsorted(contexts[j], child >> WIDE)
            move[first[j] + parent, classes[child & 511]] = first[j + 1] + np.arange(len(child))
        own_counts = counts
    return Trie(order, classes, move, logp)


def _in_order(answer: pa.Table, kind: int, code: np.ndarray, order: int, buckets: int) -> np.ndarray:
    """A block's answers of one kind, as its codes stand."""
    own = answer.filter(pc.equal(answer.column("kind"), kind)).sort_by("bucket")
    got = np.frombuffer(b"".join(own.column("answer").to_pylist()), "<f4" if kind == GRAMS else "<i8")
    if len(got) != len(code):
        raise ValueError("a block has other texts than when it was counted: the table's rows came in another order")
    out = np.empty(len(code), got.dtype)
    out[np.argsort(_buckets(kind, code, order, buckets), kind="stable")] = got
    return out


SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def scores(docs: DataFrame, train_where: Column, order: int = 5) -> DataFrame:
    """SCHEMA for every row of docs(doc_id, text); those where train_where holds are learned from."""
    size = docs.agg(F.count("*").alias("rows"), F.count_if(train_where).alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocked = blocks(docs, train_where, BLOCK * size.rows // max(1, size.bytes or 0))
    buckets = max(256, (size.bytes or 0) >> 26)
    asked = materialize(block_counts(blocked, order, buckets), "ppm")
    answered = materialize(answers(asked, order), "ppm-answers")
    discard(asked)
    texts = size.texts
    known = answered.where(F.col("kind") == WORDS).agg(F.sum("v").alias("v"), F.sum("n").alias("n")).first()
    n, v = (known.n or 0) + texts, (known.v or 0) + (texts > 0)
    floor = np.log10(n + 0.1 * (v + 1))
    end = np.log10(texts + 0.1) - floor
    kinds = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        batches = list(rows(left.select(["doc_id", "text", "train"]).to_batches(), 1 << 21))
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for code, _ in coded(batch.column(1), order):
                _add(parts, distinct(code))
        code = _merged(parts)[0]
        parts.clear()
        split = [words(batch.column(1)) for batch in batches]
        lookup = Logs(code, _in_order(right, GRAMS, code, order, buckets))
        hashes = distinct(np.concatenate([x for x, _, _ in split]))[0]
        count = _in_order(right, WORDS, hashes, order, buckets)
        log = np.log10(count + 0.1) - floor
        del right
        trim()  # before texts are gone through again
        out = []
        for batch, (own, which, of) in zip(batches, split, strict=True):
            at = np.searchsorted(hashes, own)[which]
            m = len(batch)
            model = np.zeros(m)
            for code, text in coded(batch.column(1), order):
                model += np.bincount(text, lookup.of(code), m)
            cols = [
                batch.column(0), pc.invert(batch.column(2)), np.bincount(of, minlength=m) + 1, np.bincount(of, count[at] > 0, m).astype(np.int64) + (texts > 0),
                np.full(m, n), np.bincount(of, log[at], m) + end, model,
            ]
            out.append(pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=[x.split()[0] for x in SCHEMA.split(", ")]))
        trim()
        return pa.Table.from_batches(out)

    return blocked.groupBy("block").cogroup(answered.select("block", "kind", "bucket", "answer").groupBy("block")).applyInArrow(run, SCHEMA)
